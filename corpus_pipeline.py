"""A corpus from raw documents to shards: quality classifier, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last adds shard, slot and move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import decontamination, dedup, mixing, quality, sharding
from cuelake.llm.common import new_folder


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.reshard_files(docs)


STAGES = [
    ("quality classifier", _quality),
    ("near-dedup", _near_duplicates),
    ("benchmark decontamination", _decontaminate),
    ("mixing to target weights", _mix),
    ("sharding", _shard),
]

#: The classifier is trained and sketches are hashed: SQL can't express the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
