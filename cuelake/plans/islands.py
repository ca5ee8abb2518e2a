"""Gaps-and-islands and bucketed interval joins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@contextmanager
def lying_by_file(spark: SparkSession) -> Iterator[None]:
    """What runs inside this joins rows that lie by file where they are, also where the file is one key of several. As Spark comes,
    a join of several keys deals both sides out again by all of them. Such a stage does much with each byte, so its tasks are
    small ones."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def by_file(*order) -> Window:
    return Window.partitionBy("file_id").orderBy(*(order or ("pos",)))


def island(breaks: Column, window) -> Column:
    """A number that grows at every row where breaks holds."""
    return F.sum(F.when(breaks, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], how_wide: int = 10_000, how: str = "inner") -> DataFrame:
    """Pairs that overlap by more than 0 ms. Both sides have start_ms and end_ms (right's come out as r_start_ms,
    r_end_ms, its other columns prefixed r_). Rows go to each time bucket they touch; a pair comes from the bucket
    where its overlap begins, so once. With how="left" left rows stay where they meet none, in each bucket that has none for
    them, and their overlap is null."""
    def bucketed(df: DataFrame, outer: bool = False) -> DataFrame:
        span = F.sequence(F.floor(F.col("start_ms") / how_wide), F.floor((F.greatest("end_ms", F.col("start_ms") + 1) - 1) / how_wide))
        return df.withColumn("_bucket", F.explode_outer(F.when(F.col("end_ms") > F.col("start_ms"), span)) if outer else F.explode(span))

    r = bucketed(right.filter("end_ms > start_ms"))
    r = r.select(*keys, "_bucket", *(F.col(c).alias(f"r_{c}") for c in r.columns if c not in [*keys, "_bucket"]))
    start = F.greatest("start_ms", "r_start_ms")
    overlap = F.least("end_ms", "r_end_ms") - start
    if how == "left":
        r = r.select(*(F.col(c).alias(f"_{c}") for c in [*keys, "_bucket"]), *(c for c in r.columns if c.startswith("r_")))
        meet = (overlap > 0) & (F.floor(start / how_wide) == F.col("_bucket"))
        for c in [*keys, "_bucket"]:
            meet = (F.col(c) == F.col(f"_{c}")) & meet
        pairs = bucketed(left, True).join(r, meet, "left")
        return pairs.withColumn("overlap_ms", F.when(F.col("r_start_ms").isNotNull(), overlap)).drop(*(f"_{c}" for c in [*keys, "_bucket"]), "_bucket")
    pairs = bucketed(left.filter("end_ms > start_ms")).join(r, [*keys, "_bucket"]).withColumn("overlap_ms", overlap)
    return pairs.filter((F.col("overlap_ms") > 0) & (F.floor(start / how_wide) == F.col("_bucket"))).drop("_bucket")


def contains_join(outer: DataFrame, inner: DataFrame, keys: list[str], play: int = 1, how_wide: int = 10_000, how: str = "inner") -> DataFrame:
    """Pairs where inner's span lies in outer's, with play ms at both ends; inner's other columns come out prefixed r_. An
    inner row is in the bucket of its start alone, so a pair comes once; rows longer than the outer span never meet it. With
    how="left" outer rows stay where they meet none, in each bucket that has none for them."""
    first, last = F.floor((F.col("start_ms") - play) / how_wide), F.floor((F.col("end_ms") + play) / how_wide)
    buckets = F.sequence(first, F.greatest(first, last))
    o = outer.withColumn("_bucket", F.explode(buckets) if how == "inner" else F.explode_outer(buckets))
    i = inner.withColumn("_bucket", F.floor(F.col("start_ms") / how_wide))
    i = i.select(*(F.col(c).alias(f"_{c}") for c in [*keys, "_bucket"]), *(F.col(c).alias(f"r_{c}") for c in i.columns if c not in [*keys, "_bucket"]))
    inside = (F.col("r_start_ms") >= F.col("start_ms") - play) & (F.col("r_end_ms") <= F.col("end_ms") + play)
    for c in [*keys, "_bucket"]:
        inside = (F.col(c) == F.col(f"_{c}")) & inside
    return o.join(i, inside, how).drop(*(f"_{c}" for c in [*keys, "_bucket"]), "_bucket")


def neighbours(rows: DataFrame, lane: DataFrame, at: str, around: int, *columns: str) -> DataFrame:
    """rows with window, the lane's rows (columns as structs, ordered by pos) whose pos is within around of the row's place at.
    Rows and lane meet in one pass over a file, so what is around a row is never shuffled."""
    l = lane.filter("pos is not null").select("file_id", F.col("pos").cast("long").alias("_at"), F.struct("pos", *columns).alias("_lane"))
    r = rows.filter(F.col(at).isNotNull()).select("file_id", F.col(at).cast("long").alias("_at"), F.struct(*rows.columns).alias("_row"))
    w = Window.partitionBy("file_id").orderBy("_at").rangeBetween(-around, around)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_near", F.collect_list("_lane").over(w)).filter("_row is not null")
    shown = F.transform(F.array_sort("_near"), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    return both.select("_row.*", shown.alias("window"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """Pairs with |left_at - right_at| <= width. Left rows go to three buckets of that width, right rows to one."""
    l = left.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(left_at) / width) + k for k in (-1, 0, 1)))))
    r = right.withColumn("_bucket", F.floor(F.col(right_at) / width))
    r = r.select(*keys, "_bucket", *(F.col(c).alias(f"r_{c}") for c in r.columns if c not in [*keys, "_bucket"]))
    return l.join(r, [*keys, "_bucket"]).filter(F.abs(F.col(left_at) - F.col(f"r_{right_at}")) <= width).drop("_bucket")
