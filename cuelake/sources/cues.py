"""Cue files: parsers of SRT, WebVTT and ASS texts, decoding of legacy encodings, and the writers."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.timecode import parse_timing, timing
from cuelake.plans.once import once

_STAMP = r"\d+:\d+:\d+[,.]\d+\s*-->\s*\d+:\d+:\d+[,.]\d+"
#: Folders that written files are spread over where there may be millions.
SPREAD = 1024
#: Orders in which encodings are tried after a byte order mark.
CONVERT, REVIEW = ("utf-8", "cp932", "gb18030"), ("utf-8", "gbk")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.srt", least: int = 0, most: int | None = None, after: str | None = None, before: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files under a folder as binaryFile rows, filtered by name, size, date and excluded name patterns. Tasks list the folder, a
    share each, so nothing on the driver grows with the files' number; a file's content is read where the column is used."""
    from pyarrow import fs

    from cuelake.sources.cue_source import cue_files, shares_of

    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(root).type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    prefix = "file:" if isinstance(store, fs.LocalFileSystem) else folder[: folder.index(root)]

    @F.arrow_udf("binary")
    def read(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in paths:
            parts = []
            for path in batch.to_pylist():
                with store.open_input_stream(path.removeprefix(prefix)) as f:
                    parts.append(f.read())
            yield pa.array(parts, pa.binary())

    listed = cue_files(spark, folder, pattern=pattern, shares=shares_of(spark), content="false")
    rows = listed.select(F.concat(F.lit(prefix), "path").alias("path"), F.date_trunc("millisecond", "modified").alias("modificationTime"), F.col("bytes").alias("length")).filter(F.col("length") >= least)
    for value, late in ((after, F.col("modificationTime") > F.lit(after).cast("timestamp")), (before, F.col("modificationTime") < F.lit(before).cast("timestamp"))):
        rows = rows.filter(late) if value else rows
    rows = rows if most is None else rows.filter(F.col("length") <= most)
    name = F.element_at(F.split("path", "/"), -1)
    for glob in exclude:
        like = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in glob) + "$"
        rows = rows.filter(~name.rlike(like))
    return rows.withColumn("content", read("path"))


def scan_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_distinct(F.regexp_replace("path", "/[^/]*$", "")).alias("folders"))


def decode(files: DataFrame, ladder: tuple[str, ...] = CONVERT) -> DataFrame:
    """content bytes to text, encoding and error. Rejected files have no text and name the reason."""
    @F.arrow_udf("text string, encoding string, error string")
    def step(raw: pa.Array) -> pa.Array:
        def one(data):
            if data is None:
                return None, None, "no content"
            for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
                if bytes(data).startswith(mark):
                    return bytes(data).decode(name, errors="replace"), name, None
            for name in ladder:
                try:
                    return bytes(data).decode(name), name, None
                except UnicodeDecodeError:
                    pass
            return None, None, "no encoding fits"

        parts = [pa.array([], pa.struct([(name, pa.string()) for name in ("text", "encoding", "error")]))]
        for at in range(0, len(raw), 64):  # so few texts are Python strings at a time
            rows = zip(*(one(x.as_py()) for x in raw.slice(at, 64)), strict=True)
            parts.append(pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in rows], ["text", "encoding", "error"]))
        return pa.concat_arrays(parts)

    return files.withColumn("_d", step(F.col("content"))).select("*", "_d.*").drop("_d")


def parse_srt(files: DataFrame, strict: bool = True) -> DataFrame:
    """files (file_id, content) to cue rows. Strict drops malformed blocks; tolerant keeps them: the index is the place,
    missing timings are 0; a block of nothing but a number is noise and goes in both."""
    text = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^﻿", "")
    blocks = files.select("file_id", F.posexplode(F.split(T.strip(text), r"\n\s*\n")).alias("block", "b"))
    idx = F.regexp_extract("b", r"^\s*(\d+)\s*\n", 1)
    when = F.regexp_extract("b", f"({_STAMP})", 1)
    if strict:
        rows = blocks.filter(F.col("b").rlike(r"(?s)^\s*\d+\s*\n\s*" + _STAMP + r"[^\n]*\n.*\S"))
    else:
        rows = blocks.filter((T.strip(F.col("b")) != "") & ~T.strip(F.col("b")).rlike(r"^[+-]?\d+$"))
    body = F.when(when != "", F.regexp_replace("b", r"(?s)^.*?-->[^\n]*\n?", "")).otherwise(F.regexp_replace("b", r"^\s*\d+\s*\n", ""))
    at = parse_timing(when)
    pos = F.row_number().over(Window.partitionBy("file_id").orderBy("block")) - 1
    rows = rows.withColumn("pos", pos)
    return rows.select("file_id", "pos", F.when(idx != "", idx.cast("int")).otherwise(F.col("pos") + 1).alias("idx"), F.coalesce(at["start_ms"], F.lit(0)).alias("start_ms"), F.coalesce(at["end_ms"], F.lit(0)).alias("end_ms"), T.strip(body).alias("text"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("line", "raw")).withColumn("s", F.trim("raw"))


def _clock(c, digits: int = 3):
    """H:MM:SS.fff, or MM:SS.fff, in ms; null for anything else."""
    shape = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})\s*$"
    parts = F.split(F.regexp_replace(F.regexp_extract(c, shape, 0), shape, "$1:$2:$3:$4"), ":")
    hours = lambda p: F.when(p[0] == "", 0).otherwise(p[0].try_cast("long"))
    at = lambda p: F.when(F.size(p) == 4, ((hours(p) * 60 + p[1].try_cast("long")) * 60 + p[2].try_cast("long")) * 1000 + F.rpad(p[3], digits, "0").try_cast("long"))
    return F.get(F.transform(F.array(parts), at), F.lit(0))  # the parts are named once, so they are found once


def parse_vtt(files: DataFrame) -> DataFrame:
    """WebVTT rows: a line with --> opens a block, a blank line closes it."""
    w = Window.partitionBy("file_id").orderBy("line")
    opens = F.contains("s", F.lit("-->"))
    rows = _lines(files).withColumn("opens", opens).withColumn("block", F.sum(F.col("opens").cast("int")).over(w))
    closed = F.max(F.when((F.col("s") == "") & ~F.col("opens"), 1).otherwise(0)).over(Window.partitionBy("file_id", "block").orderBy("line"))
    rows = rows.filter("block > 0").withColumn("closed", closed).filter("closed = 0")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("line", "s")))), lambda x: x["s"]), "\n")
    out = rows.groupBy("file_id", "block").agg(F.min("line").alias("line"), F.max(F.when(F.col("opens"), F.col("s"))).alias("head"), parts.alias("text"))
    left, right = F.split("head", "-->")[0], F.split(F.trim(F.split("head", "-->")[1]), r"\s+")[0]
    return out.select("file_id", (F.col("line") + 1).alias("line"), _clock(left).alias("start_ms"), _clock(right).alias("end_ms"), "text")


def parse_ass(files: DataFrame) -> DataFrame:
    """Dialogue rows of [Events], read by the columns of the latest Format line. Rows that don't fit keep line and text only."""
    w = Window.partitionBy("file_id").orderBy("line")
    rows = _lines(files)
    rows = rows.withColumn("section", F.last(F.when(F.col("s").rlike(r"^\[.*\]$"), F.lower("s")), True).over(w)).filter("section = '[events]'")
    names = F.transform(F.split(F.regexp_replace(F.lower("s"), "^format:", ""), ","), lambda x: F.trim(x))
    rows = rows.withColumn("format", F.last(F.when(F.lower("s").rlike("^format:"), names), True).over(w))
    rows = once(rows.filter(F.lower("s").rlike("^dialogue:")), payload=F.trim(F.regexp_replace("s", "(?i)^dialogue:", "")), n=F.size("format"))
    rows = once(rows, fields=F.split("payload", ","), named=F.coalesce(F.size(F.array_intersect("format", F.array(F.lit("start"), F.lit("end"), F.lit("text")))) == 3, F.lit(False)))
    # The last column takes the rest of the line.
    last = F.array_join(F.slice("fields", F.col("n"), F.size("fields")), ",")
    rows = once(rows, values=F.when(F.col("named") & (F.size("fields") >= F.col("n")), F.concat(F.slice("fields", F.lit(1), F.col("n") - 1), F.array(last))))
    fits = F.col("values").isNotNull()
    value = lambda name: F.get("values", (F.array_position("format", F.lit(name)) - 1).cast("int"))
    return rows.select("file_id", (F.col("line") + 1).alias("line"), _clock(value("start")).alias("start_ms"), _clock(value("end")).alias("end_ms"), F.when(fits, value("text")).otherwise(F.col("payload")).alias("text"))


def converted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed VTT or ASS rows to cues: empty events go (second frame: file_id, line, text), starts inside the row before
    move to its end, inline tags are stripped and counted."""
    raw = rows.withColumn("_raw", F.coalesce("text", F.lit(""))).drop("text")
    clean = once(once(raw, _bare=T.strip_tags(F.col("_raw")), tags=T.tag_count(F.col("_raw"))), text=T.strip(F.col("_bare"))).drop("_raw", "_bare")
    bad = (F.col("text") == "") | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    w = Window.partitionBy("file_id").orderBy("start_ms", "end_ms", "line")
    good = clean.filter(~bad).withColumns({"pos": F.row_number().over(w) - 1, "start_ms": F.greatest("start_ms", F.coalesce(F.lag("end_ms").over(w), F.col("start_ms")))})
    return good.select("file_id", "pos", (F.col("pos") + 1).alias("idx"), "start_ms", "end_ms", "text", "tags"), clean.filter(bad).select("file_id", "line", "text")


def format_srt(cues: DataFrame) -> DataFrame:
    """One content string per file: rows renumbered in order, blank lines inside texts removed. A file is a bounded group."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\s*\n+", "\n")
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("pos"))
    block = F.concat_ws("\n", n.cast("string"), timing(F.col("start_ms"), F.col("end_ms")), text)
    rows = cues.withColumn("_b", block)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_b"))), lambda x: x["_b"]), "\n\n")
    return rows.groupBy("file_id").agg(F.concat(joined, F.lit("\n")).alias("content"))


def write_srt(cues: DataFrame, folder: str, spread: int = 0) -> None:
    """A folder per file with its text, in as many folders more as spread says, by hash, so that no listing gets all files. Tasks
    write the files in place, each under a hidden name until it is whole, so that
    nothing on the driver grows with their number; a task that runs again writes the same files."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    store.create_dir(root)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file_id, content in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                place = f"{zlib.crc32(str(file_id).encode()) % spread:03x}/" if spread else ""
                own = f"{root}/{place}file_id={file_id}"
                hidden = f"{own}/.{uuid.uuid4().hex}"
                store.create_dir(own)
                with store.open_output_stream(hidden) as f:
                    f.write(content)
                store.move(hidden, f"{own}/cues.txt")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    format_srt(cues).select("file_id", F.encode("content", "UTF-8")).mapInArrow(put, "files long").agg(F.sum("files")).collect()


def to_cues(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of mixed formats (file_id, name, content bytes) to cues, and warnings (file_id, line, warning): files that no
    encoding fits or whose format is unknown, and events without text or times. SRT files pass through the parser."""
    texts = decode(files).withColumn("format", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    of = lambda *names: texts.filter(F.col("text").isNotNull() & F.col("format").isin(*names)).select("file_id", F.col("text").alias("content"))
    good, bad = converted(parse_vtt(of("vtt")).unionByName(parse_ass(of("ass", "ssa"))))
    names = ["file_id", "pos", "idx", "start_ms", "end_ms", "text"]
    cues = good.select(*names).unionByName(parse_srt(of("srt")).select(*names))
    whole = texts.select("file_id", F.lit(None).cast("int").alias("line"), F.when(F.col("text").isNull(), F.col("error")).when(~F.col("format").isin("vtt", "ass", "ssa", "srt"), "unknown format").alias("warning")).filter("warning is not null")
    events = bad.select("file_id", "line", F.when(F.col("text") == "", "empty event").otherwise("event without times").alias("warning"))
    return cues, whole.unionByName(events)


def read_wav(files: DataFrame, hop_ms: int = 10) -> DataFrame:
    """16-bit PCM WAV files (file_id, content) to rows (file_id, hop_no, rms), mono mixed."""
    import io
    import wave

    import numpy as np

    def hops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file_id, raw in zip(f["file_id"], f["content"], strict=True):
                with wave.open(io.BytesIO(bytes(raw))) as w:
                    size, at = w.getframerate() * hop_ms // 1000, 0
                    while data := w.readframes(size * 6000):
                        x = np.frombuffer(data, "<i2").astype(float).reshape(-1, w.getnchannels()).mean(axis=1)
                        x = x[: len(x) // size * size].reshape(-1, size)
                        yield pd.DataFrame({"file_id": file_id, "hop_no": np.arange(at, at + len(x)), "rms": np.sqrt((x * x).mean(axis=1))})
                        at += len(x)

    return files.select("file_id", "content").mapInPandas(hops, "file_id long, hop_no long, rms double")
