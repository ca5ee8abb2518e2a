"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the transfers that move the fewest bytes.

A sharded corpus is a folder of files under data/gen=G/shard=K/file=F and a manifest that names, for its newest
version, the files of every shard in order. Files of a shard hold blocks of documents (size class, then hash digit; heavy blocks are several files),
largest documents first, and each document's place and byte offset in its file.

To reshard, the flow between shards is solved on shard totals alone. Each old shard gives its files, in order, first
to itself and then to the shards that the flow names; a file that a boundary cuts is split by document at its byte
offset. Only the files that are cut or leave their shard are rewritten, into a new generation; all other files stay
as they are and are carried over by the next manifest, which is the commit: a failed attempt leaves a generation
that no manifest names. Slots are the manifest's running counts plus the place in the file.

Decisions are joins with tables of files or spans, so documents carry their text through one shuffle per write.

Edge cases: a null text has 0 bytes and a null checksum; equal rows are interchangeable; an empty table gives
empty shards; a column named shard, slot or move of the input is replaced.
"""

from __future__ import annotations

import heapq
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuelake.llm.common import durable, new_folder, row_hash, small
from cuelake.plans.versions import removed

OVERHEAD = 16
DIGITS = 64
#: Files that a shard is cut into, and the least and most bytes of one.
FILES, FILE_BYTES = 8, (1 << 20, 128 << 20)
MANIFEST = "gen string, shard int, file int, seq long, rows long, bytes long, first_slot long, fresh boolean, version int"


def stored_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def min_cost_transfers(sizes: list[int], capacities: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at the least total cost, by successive cheapest paths.

    The graph has a node per shard; its size doesn't depend on the documents. Capacities sum to the sizes at least.
    """
    m, n = len(sizes), len(capacities)
    flow: dict[tuple[int, int], int] = {}
    room, potential = list(capacities), [0] * (m + n)
    for i in sorted(range(m), key=lambda k: -sizes[k]):
        left = sizes[i]
        while left > 0:
            dist, came, heap = {i: 0}, {}, [(0, i)]
            best = None
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist.get(u, math.inf):
                    continue
                if u >= m and room[u - m] > 0:
                    best = u
                    break
                edges = [(m + j, cost(u, j)) for j in range(n)] if u < m else [(k, -cost(k, u - m)) for k in range(m) if flow.get((k, u - m), 0) > 0]
                for v, c in edges:
                    nd = d + max(0, c + potential[u] - potential[v])
                    if nd < dist.get(v, math.inf):
                        dist[v], came[v] = nd, u
                        heapq.heappush(heap, (nd, v))
            if best is None:
                raise ValueError("capacities are below the sizes")
            limit = dist[best]
            for v in range(m + n):
                potential[v] += min(dist.get(v, limit), limit)
            path, v = [], best
            while v != i:
                path.append((came[v], v))
                v = came[v]
            amount = min([left, room[best - m], *(flow[(v, u - m)] for u, v in path if u >= m)])
            for u, v in path:
                key = (u, v - m) if u < m else (v, u - m)
                flow[key] = flow.get(key, 0) + (amount if u < m else -amount)
            room[best - m] -= amount
            left -= amount
    return {k: v for k, v in flow.items() if v > 0}


def _unnamed(docs: DataFrame) -> DataFrame:
    return docs.drop("shard", "slot", "move")


def _file_bytes(shard_bytes: int) -> int:
    return min(max(shard_bytes // FILES, FILE_BYTES[0]), FILE_BYTES[1])


def _write(rows: DataFrame, path: str, gen: str) -> None:
    """Rows (_row, _h, _size, _from, shard, file) as files of one generation, each with its places and byte offsets."""
    order = Window.partitionBy("shard", "file").orderBy(F.desc("_size"), "_h")
    rows = rows.repartition("shard", "file").withColumns({"_pos": (F.row_number().over(order) - 1).cast("long"), "_off": F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")})
    rows.select("_row", "_h", "_size", "_from", "_pos", "_off", "shard", "file").write.partitionBy("shard", "file").parquet(f"{path}/data/gen={gen}")


def _data(spark: SparkSession, path: str, row: StructType, folders: list[str]) -> DataFrame:
    """The rows of the named folders under data, a whole generation or single files; nothing else is listed or read."""
    schema = StructType().add("_row", row)
    for name, kind in (("_h", "long"), ("_size", "long"), ("_from", "integer"), ("_pos", "long"), ("_off", "long"), ("gen", "string"), ("shard", "integer"), ("file", "integer")):
        schema = schema.add(name, kind)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*(f"{path}/data/{f}" for f in folders))


def _named(files: DataFrame) -> list[str]:
    """The folders of a manifest's rows: a short name for each file, of which a shard has few."""
    return [f"gen={r['gen']}/shard={r['shard']}/file={r['file']}" for r in files.select("gen", "shard", "file").collect()]


def _commit(files: DataFrame, path: str, version: int) -> None:
    """files (gen, shard, file, seq, rows, bytes, fresh) as the newest version. One small file is the commit."""
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("seq")) - F.col("rows")
    names = ["gen", "shard", "file", "seq", "rows", "bytes", "first_slot", "fresh"]
    files.withColumn("first_slot", before).select(*names, F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of the newest committed version."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    newest = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == (newest or 0))


def _counted(data: DataFrame, version: int) -> DataFrame:
    rows = data.groupBy("gen", "shard", "file").agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes"))
    return rows.withColumns({"seq": F.lit(version << 32) + F.col("file"), "fresh": F.lit(True)})


def lay_out(docs: DataFrame, path: str, shards: int = 32, shard: Column | None = None, file_bytes: int | None = None) -> None:
    """Write a corpus as version 0 of a sharded folder. Without a column of shards, documents go where their hash says."""
    place = docs if shard is None else docs.withColumn("_place", shard)
    own = F.struct(*_unnamed(docs).columns).alias("_row")
    rows = place.select(own, row_hash(F.col("doc_id"), F.col("text")).alias("_h"), stored_size(F.col("text")).alias("_size"), *([] if shard is None else ["_place"]))
    rows = rows.withColumn("shard", (F.pmod(F.col("_h"), F.lit(shards)) if shard is None else F.col("_place")).cast("int")).withColumns({
        "_from": F.col("shard"), "_class": (F.lit(80) - F.floor(F.log2("_size") * 2)).cast("int"), "_dig": F.pmod(F.shiftright("_h", 20), F.lit(DIGITS)).cast("int"),
    })
    block = ["shard", "_class", "_dig"]
    blocks = durable(rows.groupBy(*block).agg(F.sum("_size").alias("_bytes")))
    if file_bytes is None:
        file_bytes = _file_bytes(blocks.groupBy("shard").agg(F.sum("_bytes").alias("b")).agg(F.max("b")).first()[0] or 0)
    before = F.sum("_bytes").over(Window.partitionBy("shard").orderBy("_class", "_dig")) - F.col("_bytes")
    placed = durable(blocks.withColumn("_first", before))
    gen = f"g0-{uuid.uuid4().hex}"
    # A block's documents are spread evenly over its bytes, so a heavy block is as many files as its bytes ask for.
    spread = F.col("_h").bitwiseAND(F.lit((1 << 20) - 1)) / F.lit(1 << 20)
    rows = rows.join(small(placed), block).withColumn("file", F.floor((F.col("_first") + spread * F.col("_bytes")) / F.lit(file_bytes)).cast("int"))
    _write(rows, path, gen)
    data = _data(docs.sparkSession, path, _unnamed(docs).schema, [f"gen={gen}"])
    _commit(_counted(data, 0), path, 0)


def plan(files: DataFrame, old_shards: int, new_shards: int) -> DataFrame:
    """The manifest's files with _before (bytes of their shard in front of them), shares (an array of (upto, shard) in
    order: who gets the shard's bytes up to there) and stays (whole, in its shard)."""
    old = {r["shard"]: r["b"] for r in files.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # a row per shard
    sizes = [old.get(i, 0) for i in range(max([old_shards, *(k + 1 for k in old)]))]
    total = sum(sizes)
    transfers = min_cost_transfers(sizes, [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)])
    spans = []
    for i in range(len(sizes)):
        at = 0
        for j in sorted((j for k, j in transfers if k == i), key=lambda j: (j != i, j)):
            spans.append((i, at, at + transfers[i, j], j))
            at += transfers[i, j]
    spans = files.sparkSession.createDataFrame(spans, "shard int, _start long, upto long, to int")  # at most old + new shards
    before = F.sum("bytes").over(Window.partitionBy("shard").orderBy("seq")) - F.col("bytes")
    parts = files.withColumn("_before", before).join(small(durable(spans)), "shard")
    parts = parts.filter((F.col("upto") > F.col("_before")) & (F.col("_start") < F.col("_before") + F.col("bytes")))
    shares = F.sort_array(F.collect_list(F.struct("upto", "to"))).alias("shares")  # a file's part of its shard's spans
    rows = parts.groupBy("gen", "shard", "file", "seq", "rows", "bytes", "_before").agg(shares)
    return durable(rows.withColumn("stays", (F.size("shares") == 1) & (F.element_at("shares", 1)["to"] == F.col("shard"))))


def reshard(spark: SparkSession, path: str, row: StructType, new_shards: int = 40, old_shards: int = 32, file_bytes: int | None = None) -> None:
    """The next version of a sharded folder, in which new_shards shards have sizes as equal as documents allow."""
    current = durable(manifest(spark, path))
    version = (current.agg(F.max("version")).first()[0] or 0) + 1
    files = plan(current, old_shards, new_shards)
    if file_bytes is None:
        file_bytes = _file_bytes((files.agg(F.sum("bytes")).first()[0] or 0) // new_shards)
    went = files.filter("not stays").select("shard", "_before", "bytes", F.posexplode("shares").alias("_k", "s"), "shares")
    given = F.least(F.col("s.upto"), F.col("_before") + F.col("bytes")) - F.greatest(F.when(F.col("_k") > 0, F.get("shares", F.col("_k") - 1)["upto"]).otherwise(F.col("_before")), F.col("_before"))
    counts = durable(went.groupBy(F.col("s.to").alias("to")).agg(F.ceil(F.sum(given) / F.lit(file_bytes)).cast("int").alias("_files")))  # a row per shard
    moving = files.filter("not stays").select("gen", "shard", "file", "_before", "shares")
    rows = _data(spark, path, row, _named(moving)).join(small(durable(moving)), ["gen", "shard", "file"])
    middle = F.col("_before") + F.col("_off") + F.col("_size") / 2
    to = F.coalesce(F.get(F.filter("shares", lambda x: middle < x["upto"]), 0), F.element_at("shares", -1))["to"]
    rows = rows.select("_row", "_h", "_size", F.col("shard").alias("_from"), to.alias("to")).join(small(counts), "to", "left")
    rows = rows.withColumn("file", F.pmod(F.shiftright("_h", 30), F.greatest(F.coalesce("_files", F.lit(1)), F.lit(1))).cast("int")).withColumnRenamed("to", "shard")
    gen = f"g{version}-{uuid.uuid4().hex}"
    _write(rows, path, gen)
    kept = files.filter("stays").select("gen", "shard", "file", "rows", "bytes", "seq", F.lit(False).alias("fresh"))
    _commit(kept.unionByName(_counted(_data(spark, path, row, [f"gen={gen}"] if moving.head(1) else []), version)), path, version)


def drop_superseded(spark: SparkSession, path: str) -> list[str]:
    """Delete the files that the newest version doesn't name, and return their folders; older versions can't be read after."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    newest = set(_named(manifest(spark, path)))
    return [f for f in sorted(set(_named(rows)) - newest) if removed(spark, f"{path}/data/{f}")]


def read_shards(spark: SparkSession, path: str, row: StructType) -> DataFrame:
    """The documents of the newest version: the input's columns, shard, slot and move (the last resharding moved it)."""
    files = durable(manifest(spark, path).select("gen", "shard", "file", "first_slot", "fresh"))
    rows = _data(spark, path, row, _named(files)).join(small(files), ["gen", "shard", "file"])
    return rows.select("_row.*", "shard", (F.col("first_slot") + F.col("_pos")).alias("slot"), (F.col("fresh") & (F.col("_from") != F.col("shard"))).alias("move"))


def reshard_files(docs: DataFrame, new_shards: int = 40, old_shards: int = 32, old_shard: Column | None = None, path: str | None = None, file_bytes: int | None = None) -> DataFrame:
    """Lay all documents out in their old shards, reshard the folder, and read it back."""
    path, row = path or new_folder(docs.sparkSession, "shards"), _unnamed(docs).schema
    lay_out(docs, path, old_shards, old_shard, file_bytes)
    reshard(docs.sparkSession, path, row, new_shards, old_shards, file_bytes)
    drop_superseded(docs.sparkSession, path)
    return read_shards(docs.sparkSession, path, row)


def shard_report(docs: DataFrame, new_shards: int = 40, old_shards: int = 32, **options) -> DataFrame:
    files = reshard_files(docs.select("doc_id", "text"), new_shards, old_shards, **options)
    return files.select("doc_id", stored_size(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "move")
