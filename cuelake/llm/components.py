"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_ROWS, durable, gathered


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label (the smallest node reachable) for every node of links (a, b). Nodes without links aren't listed.

    A round takes the smallest label among a node and its neighbours, then the label of that label. The number of
    rounds is logarithmic in the longest path for most graphs; running out of rounds is an error, not a guess.
    """
    edges = gathered(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    few = edges.count() <= BROADCAST_ROWS  # labels are no more than edges
    tasks, side = edges.rdd.getNumPartitions(), F.broadcast if few else lambda df: df
    held = lambda df: durable(df.coalesce(tasks) if few else df)
    labels = held(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(rounds):
        seen = edges.join(side(labels.withColumnsRenamed({"node": "b"})), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = held(seen.join(side(labels), "node").select("node", F.least("label", "near").alias("near"), F.col("label").alias("old")))
        jump = near.select(F.col("node").alias("near"), F.col("near").alias("label"))
        labels = held(near.join(side(jump), "near").select("node", F.least("near", "label").alias("label"), "old"))
        changed = labels.filter("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("the links form a path too long for this many rounds")
