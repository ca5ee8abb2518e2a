"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.plans.versions import settled


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with name, the place of each row in the order, from 1. One range sort lays the rows out; a row's number inside its
    partition and the counts of the partitions before it, a number each on the driver, make the place."""
    laid = settled(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()  # partition and row number inside it
    laid = laid.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33))
    counts = sorted(map(tuple, laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()))
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return laid.join(offsets, "_part").withColumn(name, place).drop("_at", "_part", "_before")
