"""Mixing sources to target weights by hash-threshold histograms, without sorting.

Sizes are summed by source and hash digit; the digit where a source's budget runs out is refined twice,
down to single hash values. Every document below the bound is taken, so applying the mix is one filter
against a row of bounds per source. What a large document at the bound leaves open is filled by further
rounds over the untaken documents that still fit.

Edge cases: a null text has size 0; null is a source of its own, last in order; equal rows (same id and
text) share a hash and are taken together; an empty table gives an empty mix; a column of the input whose
name the operator also returns is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import durable, row_hash, small, word_count

ROUNDS = 3
_TOP = 1 << 60
_DIGITS = ((48, 0xFFF), (36, 0xFFF), (0, 0xFFFFFFFFF))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input with _src (an ordering key that is never null), _n (size in words) and _h (row hash)."""
    src = F.when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    return docs.withColumns({"_src": src, "_n": word_count(F.col(text_col)), "_h": row_hash(F.col(id_col), F.col(text_col))})


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Budgets for rows (_src, source_size): weights repeat over the sources in order, no target is above
    max_repeat times its source. Sharing the excess again by weight until none is above is filling water:
    the level is the largest of the levels that leave out the first sources by cap over weight."""
    ordered = Window.orderBy("_src")
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_src")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumns({"_w": weight.cast("long"), "_cap": F.col("source_size") * max_repeat})
    rows = rows.withColumn("_before", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_weights", F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_level", F.max((F.sum("source_size").over(Window.partitionBy()) - F.col("_before")) / F.col("_weights")).over(Window.partitionBy()))
    rows = rows.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return rows.withColumn("_base", base).select("_src", "source_size", "target", "_base", (F.col("target") - F.col("_base") * F.col("source_size")).alias("_left"))


def _taken(rounds: int):
    """Whether a row of (sized, plan) was taken in one of the first rounds."""
    below = [F.col("_h") < F.col(f"_bound{r}") for r in range(rounds)]
    fits = [F.lit(True)] + [F.col("_n") <= F.col(f"_room{r}") for r in range(1, rounds)]
    return reduce(lambda a, b: a | b, (x & y for x, y in zip(below, fits, strict=True)), F.lit(False))


def plan(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """One row of bounds per source from a durable frame (_src, _n, _h)."""
    rows = rows.select("_src", "_n", "_h")
    state = durable(targets(durable(rows.groupBy("_src").agg(F.sum("_n").alias("source_size"))), weights, max_repeat))
    for r in range(rounds):
        state = state.withColumns({f"_room{r}": F.col("_left"), f"_bound{r}": F.lit(0).cast("long"), "_open": F.col("_base") < max_repeat})  # a source at its cap takes no more
        for shift, mask in _DIGITS:
            left = rows.join(small(state), "_src").filter("_open")
            left = left.filter(~_taken(r) & (F.col("_n") <= F.col(f"_room{r}")) if r else F.lit(True))
            if shift != _DIGITS[0][0]:  # only the bucket where the budget runs out
                above = shift + 12 if shift else 36
                left = left.filter(F.shiftright("_h", above) == F.shiftright(f"_bound{r}", above))
            digit = F.shiftright("_h", shift).bitwiseAND(F.lit(mask))
            histogram = left.groupBy("_src", digit.alias("_d")).agg(F.sum("_n").alias("_s"), F.first("_left").alias("_left"))
            histogram = histogram.withColumn("_cum", F.sum("_s").over(Window.partitionBy("_src").orderBy("_d")))
            over = F.col("_cum") > F.col("_left")
            cut = histogram.groupBy("_src").agg(F.min(F.when(over, F.col("_d"))).alias("_d"), F.coalesce(F.min(F.when(over, F.col("_cum") - F.col("_s"))), F.max("_cum")).alias("_used"))
            joined = state.join(small(durable(cut)), "_src", "left")
            state = durable(joined.withColumns({
                "_left": F.col("_left") - F.coalesce(F.col("_used"), F.lit(0)),
                f"_bound{r}": F.when(~F.col("_open"), F.col(f"_bound{r}")).when(F.col("_d").isNull(), F.lit(_TOP)).otherwise(F.col(f"_bound{r}") + F.col("_d") * F.lit(1 << shift)),
                "_open": F.col("_open") & F.col("_d").isNotNull(),
            }).drop("_d", "_used"))
    return state


def apply_plan(rows: DataFrame, bounds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The rows of sized() with source_size, target, copies and taken."""
    out = rows.drop("source_size", "target", "copies", "taken").join(small(bounds), "_src")
    out = out.withColumn("copies", F.col("_base") + _taken(rounds).cast("long")).withColumn("taken", F.col("copies") * F.col("_n"))
    return out.drop(*(c for c in bounds.columns if c not in ("source_size", "target")))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for every document; the text is read once."""
    rows = durable(sized(docs).select("doc_id", "_src", "_n", "_h"))
    out = apply_plan(rows, plan(rows, weights, max_repeat))
    return out.select("doc_id", F.col("_n").alias("size"), "source_size", "target", "copies", "taken")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The mixed corpus: every document as many times as the mix takes it, with the columns of the input."""
    rows = sized(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source")).drop("doc_id", "text", "source")
    bounds = plan(durable(rows.select("_src", "_n", "_h")), weights, max_repeat)
    out = apply_plan(rows, bounds).filter("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def oracle(weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, rounds: int = ROUNDS) -> str:
    """The same mix by running sums over sorted documents."""
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    sql = f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{'[^\\x20\\x09-\\x0D]+'}'))::BIGINT AS size,
             substr(md5(coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '')), 1, 15) AS h FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s GROUP BY source),
b AS (SELECT *, CASE (k - 1) % {len(weights)} {weight} END AS w, {max_repeat} * source_size AS cap FROM a),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM b),
d AS (SELECT *, least(cap::DOUBLE, max(lv) OVER () * w) AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM d),
r0 AS (SELECT s.*, source_size, target, base, target - base * source_size AS room, false AS took
       FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)"""
    for r in range(1, rounds + 1):
        sql += f""",
q{r} AS (SELECT *, NOT took{' AND size <= room' if r > 1 else ''} AS cand FROM r{r - 1}),
p{r} AS (SELECT *, cand AND sum(CASE WHEN cand THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= room AS now FROM q{r}),
r{r} AS (SELECT doc_id, source, size, h, source_size, target, base, took OR now AS took,
         room - coalesce(sum(CASE WHEN now THEN size END) OVER (PARTITION BY source), 0) AS room FROM p{r})"""
    return sql + f"\nSELECT doc_id, size, source_size, target, base + (took AND base < {max_repeat})::BIGINT AS copies, size * (base + (took AND base < {max_repeat})::BIGINT) AS taken FROM r{rounds}"
