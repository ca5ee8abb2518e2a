"""The translation memory as a table of versions, into which batches of a stream are merged.

A folder holds data (a base with all rows and, for each batch since, the rows that it changed) and the manifest. A batch
reads the memory's rows of its own keys, merges them as memory.upsert does and writes the merged rows; the manifest's
row makes them visible and names the writer and the batch, so a batch that comes again changes nothing, and one
that stopped before its row was never there. Every version stays readable until it expires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cuelake.functions import text as T
from cuelake.operators import memory
from cuelake.plans import versions as V

COLUMNS = [c.split()[0] for c in memory.TM.split(", ")]


def create(tm: DataFrame, root: str) -> None:
    """Version 0: the memory as it is."""
    folder = V.new_name("base", 0)
    for name, kind in (c.split() for c in memory.TM.split(", ")):
        tm = tm.withColumn(name, F.col(name).cast(kind) if name in tm.columns else F.lit(None).cast(kind))
    memory.directed(tm).select(*COLUMNS).write.parquet(f"{root}/data/{folder}")
    V.commit(tm.sparkSession, root, 0, "base", folder, top=_top(tm.sparkSession, root, folder))


def _part(spark: SparkSession, root: str, folder: str) -> DataFrame:
    return spark.read.schema(memory.TM).parquet(f"{root}/data/{folder}")


def _top(spark: SparkSession, root: str, folder: str, least: int = 0) -> int:
    return max(least, _part(spark, root, folder).agg(F.max("id")).first()[0] or 0)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The memory at a version (the newest by default): of each key the row of the newest batch, else the base's."""
    past = V.history(spark, root, version)
    at = max(k for k, r in enumerate(past) if r["kind"] == "base")
    out, later = _part(spark, root, past[at]["folder"]), past[at + 1 :]
    if not later:
        return out
    parts = [_part(spark, root, r["folder"]).withColumn("_v", F.lit(r["version"])) for r in later]
    changed = parts[0]
    for part in parts[1:]:
        changed = changed.unionByName(part)
    newest = changed.groupBy(*memory.KEY).agg(F.max_by(F.struct(*COLUMNS), "_v").alias("_row")).select("_row.*")
    return out.join(newest.select(*memory.KEY), memory.KEY, "left_anti").unionByName(newest).select(*COLUMNS)


def upsert_batch(root: str, batch: DataFrame, writer: str, number: int) -> int:
    """Merge a batch (as memory.upsert takes it) and return the version that holds it. The same writer and number again is
    no change."""
    spark = batch.sparkSession
    past = V.history(spark, root)
    for r in past:
        if (r["writer"], r["batch"]) == (writer, number):
            return r["version"]
    version, top = past[-1]["version"] + 1, V.facts(past[-1])["top"]
    keys = memory.directed(batch.withColumn("content_hash", T.content_hash(F.col("source_text")))).select(*memory.KEY).distinct()
    own = read(spark, root).join(keys, memory.KEY, "left_semi")
    folder = V.new_name("batch", version)
    memory.upsert(own, batch, top).select(*COLUMNS).write.parquet(f"{root}/data/{folder}")
    V.commit(spark, root, version, "batch", folder, writer, number, top=_top(spark, root, folder, top))
    return version


def compact(spark: SparkSession, root: str) -> int:
    """The newest version as a base, so that reads don't merge all batches again."""
    past = V.history(spark, root)
    version = past[-1]["version"] + 1
    folder = V.new_name("base", version)
    read(spark, root).write.parquet(f"{root}/data/{folder}")
    V.commit(spark, root, version, "base", folder, top=V.facts(past[-1])["top"])
    return version


def expire(spark: SparkSession, root: str, before: int) -> list[str]:
    """Delete what only versions before the given one need, and return the folders. Batches remain known by number."""
    past = V.history(spark, root)
    first = max((k for k, r in enumerate(past) if r["kind"] == "base" and r["version"] <= before), default=0)
    gone = [r["folder"] for r in past[:first]]
    return [f for f in gone if V.removed(spark, f"{root}/data/{f}")]


def learn(pairs: DataFrame, root: str, writer: str, checkpoint: str, **options) -> StreamingQuery:
    """Merge a stream of batches into the memory, each once; options are the trigger's."""
    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            upsert_batch(root, batch, writer, number)
        finally:
            batch.unpersist()

    return pairs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
