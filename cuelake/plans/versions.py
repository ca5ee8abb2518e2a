"""Tables whose versions a manifest commits, and frames that are settled in the shared folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

MANIFEST = "version long, kind string, folder string, writer string, batch long, facts string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without, in a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cuelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint, for frames that are read more than once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_name(kind: str, version: int) -> str:
    return f"{kind}{version}-{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, version: int, kind: str, folder: str, writer: str = "", batch: int = -1, **facts) -> None:
    """Make a version visible. The row is one file that Spark moves into the manifest in one step; data that no row names
    were left by a writer that stopped before this and are never read."""
    spark.createDataFrame([(version, kind, folder, writer, batch, json.dumps(facts))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def history(spark: SparkSession, root: str, upto: int | None = None) -> list[Row]:
    """The manifest's rows up to a version, oldest first: one small row per commit. Of rows that claim the same version,
    which only writers beside each other can leave, the first by folder counts."""
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").collect()
    found: dict[int, Row] = {}
    for r in sorted(rows, key=lambda r: (r["version"], r["folder"]), reverse=True):
        found[r["version"]] = r
    return [found[v] for v in sorted(found) if upto is None or v <= upto]


def facts(row: Row) -> dict:
    return json.loads(row["facts"])


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
