"""Deterministic sharded WARC writer and its reader.

Records are range-partitioned by page_id into shards of about equal payload. The bounds come from a histogram of
bytes by the leading bits of page_id; only buckets heavier than a shard are refined, down to single ids, so they
hold however unevenly ids lie, and without sampling, so reruns give the same files. Records are sorted and streamed
into gzip members; a file is rolled when its compressed size reaches the limit. Headers and digests are regenerated from the payload. Tasks write under
temporary names that hold the attempt, report a manifest row per file, and a second job gives the files of the
attempts that succeeded their final names. The manifest table, written last, is the commit; what failed attempts
left under temporary names is deleted then.

Edge cases: a null html is an empty payload; null page_ids sort first and are kept as null; rows that repeat the
largest page_id of a payload are all responses; a null url has no target header; an id
heavier than a shard (as null may be) is split by the hash of payload digest and url, and its records are sorted by
it; any page_id of 64 bits will do; an empty table commits an empty manifest. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import durable, new_folder, small

#: Leading bits that a histogram of payload bytes tells apart at a time.
BITS = 14
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temp string, name string, records long, bytes long, sha1 string"
PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _header_text(url: str) -> str:
    return "".join(f"%{b:02X}" for b in url.encode()) if not url.isprintable() else url


def record(page_id, url, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record, headers regenerated."""
    digest = _digest(payload)
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, roll_bytes: int, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, seq, out, done = None, 0, None, []

        def close():
            nonlocal out
            if out:
                out["file"].close()
                done.append({"shard": shard, "seq": seq, "temp": out["temp"], "name": f"{root}/data/shard-{shard:06d}-{seq:05d}.warc.gz", "records": out["records"], "bytes": out["bytes"], "sha1": out["sha1"].hexdigest()})
                out = None

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for s, page_id, url, html, refers_to, revisit in zip(*columns, strict=True):
                if s != shard:
                    close()
                    shard, seq = s, 0
                elif out and out["bytes"] >= roll_bytes:
                    close()
                    seq += 1
                if out is None:
                    temp = f"{root}/temporary/{attempt}-{shard:06d}-{seq:05d}"
                    out = {"temp": temp, "file": store.open_output_stream(temp), "records": 0, "bytes": 0, "sha1": hashlib.sha1()}
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html or b"", refers_to, revisit, date)) + packer.flush()
                out["file"].write(member)
                out["sha1"].update(member)
                out["records"] += 1
                out["bytes"] += len(member)
            if done:
                yield pa.RecordBatch.from_pylist(done, _MANIFEST_SCHEMA)
                done.clear()
        close()
        yield pa.RecordBatch.from_pylist(done, _MANIFEST_SCHEMA)

    return write


_MANIFEST_SCHEMA = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
_PAGE_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _renamer(folder: str):
    """Final names for staged files. Running again is harmless."""
    def rename(batches):
        from pyarrow import fs

        store, _ = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(row["temp"]).type != fs.FileType.NotFound:
                    store.move(row["temp"], row["name"])
                if store.get_file_info(row["name"]).size != row["bytes"]:
                    raise OSError(f"{row['name']} isn't what the manifest says")
            yield batch

    return rename


def linked(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html (binary), _digest, _bytes, refers_to and revisit: of equal payloads the largest page_id is the response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumns({"_digest": F.sha1("html"), "_bytes": F.octet_length("html").cast("long")})
    groups = rows.groupBy("_digest").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_copies"), F.first("_bytes").alias("_size"))
    groups = durable(groups.filter((F.col("_copies") > 1) & (F.col("_size") >= min_revisit_bytes)).select("_digest", "_top"))
    rows = rows.join(small(groups), "_digest", "left")
    revisit = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return rows.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("_top"))}).drop("_top")


def ranges(pages: DataFrame, shard_bytes: int) -> tuple[list[tuple[int, int, int]], int]:
    """Runs of page_ids as (first id, shard, parts) in order, and the number of shards. Ids are counted from -2**63;
    null comes first, as -1. A run of several parts is one id that is heavier than a shard."""
    key = F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))  # its order as an unsigned number is that of page_id
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    nulls = pages.filter("page_id is null").agg(F.sum("_weight")).first()[0]
    leaves = [] if nulls is None else [(-1, nulls, True)]
    if low is not None:
        shift, rows = max(0, ((low + (1 << 63)) ^ (high + (1 << 63))).bit_length() - BITS), pages.filter("page_id is not null")
        while True:
            counts = rows.groupBy(F.shiftrightunsigned(key, shift).alias("p")).agg(F.sum("_weight").alias("w")).collect()  # at most 2 ** BITS rows and two per shard
            found = [(r["p"] % (1 << 64), r["w"]) for r in counts]
            heavy = [p for p, w in found if w > shard_bytes and shift]
            leaves += [(p << shift, w, not shift) for p, w in found if w <= shard_bytes or not shift]
            if not heavy:
                break
            finer = shift - min(shift, max(1, BITS - len(heavy).bit_length()))
            wanted = pages.sparkSession.createDataFrame([(p,) for p in heavy], "p long")  # a row per shard at most
            rows = pages.filter("page_id is not null").join(F.broadcast(wanted), F.shiftrightunsigned(key, shift) == F.col("p"), "left_semi")
            shift = finer
    runs, at, filled = [], 0, 0
    for first, weight, single in sorted(leaves):
        parts = max(1, round(weight / shard_bytes)) if single else 1
        if filled and (parts > 1 or filled + weight > shard_bytes):
            at, filled = at + 1, 0
        if not filled:
            runs.append((first, at, parts))
        at, filled = (at + parts, 0) if parts > 1 else (at, filled + weight)
    return runs or [(-1, 0, 1)], max(1, at + (filled > 0))


def sharded(rows: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
    """The rows with _h, by which an id's records are ordered, and shard. There are no more runs than shards."""
    first = np.array([max(f, 0) for f, _, _ in runs], np.uint64)
    null = runs[0] if runs[0][0] < 0 else None
    at, parts = (np.array([r[k] for r in runs]) for k in (1, 2))

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, known: pd.Series, h: pd.Series) -> pd.Series:
        unsigned = page_id.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        run = np.maximum(np.searchsorted(first[int(null is not None) :], unsigned, "right") - 1 + int(null is not None), 0)
        run = np.where(known.to_numpy(bool), run, 0)
        return pd.Series(at[run] + np.minimum((h.to_numpy(np.int64) / float(1 << 60) * parts[run]).astype(np.int64), parts[run] - 1))

    h = F.conv(F.substring(F.md5(F.concat_ws("|", "_digest", "url").cast("binary")), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("_h", h)
    return rows.withColumn("shard", shard(F.coalesce("page_id", F.lit(0).cast("long")), F.col("page_id").isNotNull(), F.col("_h")))


def write_archives(pages: DataFrame, folder: str, shard_bytes: int | None = None, roll_bytes: int = 1 << 30, level: int = 6, date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per page under folder and return the committed manifest. Shards default to 1/2048 of all
    payload, between 8 MB and 1 GB."""
    spark: SparkSession = pages.sparkSession
    weight = F.coalesce(F.octet_length(F.col("html").cast("binary")), F.lit(0)).cast("long") + 512
    sizes = durable(pages.select(F.col("page_id").cast("long").alias("page_id"), weight.alias("_weight")))
    if shard_bytes is None:
        shard_bytes = min(max((sizes.agg(F.sum("_weight")).first()[0] or 0) // 2048, 8 << 20), 1 << 30)
    runs, shards = ranges(sizes, shard_bytes)
    rows = sharded(linked(pages, min_revisit_bytes), runs)
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "_h", "url")
    _prepare(spark, folder)
    staged = durable(rows.select("shard", "page_id", "url", "html", "refers_to", "revisit").mapInArrow(_writer(folder, roll_bytes, level, date), MANIFEST))
    staged.repartition(max(1, shards // 8), "name").mapInArrow(_renamer(folder), MANIFEST).drop("temp").write.parquet(f"{folder}/manifest")
    store, root = _store(folder)
    store.delete_dir(f"{root}/temporary")
    return spark.read.parquet(f"{folder}/manifest")


def _prepare(spark: SparkSession, folder: str) -> None:
    store, root = _store(folder)
    for sub in ("temporary", "data"):
        store.create_dir(f"{root}/{sub}", recursive=True)


def parse_records(stream) -> Iterator[dict]:
    """Records of an open gzip'd WARC file, one in memory at a time."""
    unpack, buffer = zlib.decompressobj(31), b""
    data = b""
    while True:
        chunk = unpack.unused_data or stream.read(1 << 16)
        if unpack.eof:
            if not chunk:
                return
            unpack = zlib.decompressobj(31)
        elif not chunk:
            if buffer:
                raise OSError("a record is cut off")
            return
        buffer += unpack.decompress(chunk)
        if not unpack.eof:
            continue
        data, buffer = buffer, b""
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if f"sha1:{_digest(block)}" != fields["WARC-Block-Digest"]:
            raise OSError(f"{fields['WARC-Record-ID']}: its block doesn't match its digest")
        yield fields | {"block": block}


def _reader(folder: str, payloads: bool):
    def read(batches):
        store, _ = _store(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with store.open_input_stream(name, compression=None) as stream:
                    for r in parse_records(stream):
                        revisit = r["WARC-Type"] == "revisit"
                        payload = None if revisit else r["block"].partition(b"\r\n\r\n")[2]
                        digest, size = r["WARC-Payload-Digest"].removeprefix("sha1:"), int(r["X-Payload-Length"])
                        if payload is not None and (_digest(payload), len(payload)) != (digest, size):
                            raise OSError(f"{r['WARC-Record-ID']}: its payload doesn't match its digest")
                        whole = lambda k: int(r[k]) if k in r else None  # noqa: B023, E731
                        rows.append({"page_id": whole("X-Page-Id"), "url": r.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": r["WARC-Type"], "refers_to": whole("X-Refers-To-Page-Id"), "payload": payload if payloads else None})
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, _PAGE_SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, _PAGE_SCHEMA)

    return read


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The pages of a committed archive; digests are checked while reading."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("name", "shard")
    files = max(1, manifest.count())
    return manifest.repartition(min(files, 10_000), "name").select("name").mapInArrow(_reader(folder, payloads), PAGE)


def archive_report(pages: DataFrame, **options) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder, payloads=False).drop("payload", "url")
