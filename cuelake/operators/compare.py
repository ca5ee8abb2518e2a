"""Comparing versions of files: row differences, positional agreement, measures of one version."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans.islands import by_file, interval_join, island


def output_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans where two versions differ: the texts of both sides and same, changed, only_a or only_b."""
    key = ["file_id", "start_ms", "end_ms"]
    side = lambda df, x: df.groupBy(*key).agg(F.min("text").alias(x))
    rows = side(a, "a").join(side(b, "b"), key, "full_outer")
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return rows.withColumn("status", status)


def folder_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files (name, content) of two folders: status by content hash, and the number of differing lines."""
    lines = lambda df, x: df.select("name", F.posexplode(F.split("content", "\n")).alias("no", x))
    hashes = lambda df, x: df.select("name", F.sha2(F.col("content").cast("binary"), 256).alias(x))
    files = hashes(a, "ha").join(hashes(b, "hb"), "name", "full_outer")
    changed = files.filter("ha <> hb").select("name")
    diff = lines(a.join(changed, "name", "left_semi"), "la").join(lines(b.join(changed, "name", "left_semi"), "lb"), ["name", "no"], "full_outer")
    diff = diff.filter(~F.col("la").eqNullSafe(F.col("lb"))).groupBy("name").agg(F.count(F.lit(1)).alias("lines"))
    status = F.when(F.col("hb").isNull(), "only_a").when(F.col("ha").isNull(), "only_b").when(F.col("ha") == F.col("hb"), "same").otherwise("changed")
    return files.join(diff, "name", "left").select("name", status.alias("status"), F.coalesce("lines", F.lit(0)).alias("lines"))


def positional_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per file: rows at equal places, and the shares with equal timing and equal text."""
    right = b.select("file_id", "pos", F.col("start_ms").alias("s2"), F.col("text").alias("t2"))
    rows = a.join(right, ["file_id", "pos"])
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("start_ms") == F.col("s2")).cast("double")).alias("same_start"), F.avg((F.col("text") == F.col("t2")).cast("double")).alias("same_text"))


def speech_union(cues: DataFrame) -> DataFrame:
    """Per file the length of the union of its spans."""
    w = by_file("start_ms", "end_ms")
    rows = cues.filter("end_ms > start_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", island(F.coalesce(F.col("start_ms") > reach, F.lit(True)), w))
    spans = rows.groupBy("file_id", "island").agg((F.max("end_ms") - F.min("start_ms")).alias("ms"))
    return spans.groupBy("file_id").agg(F.sum("ms").alias("speech_ms"), F.count(F.lit(1)).alias("spans"))


def version_measures(cues: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per file: share of very short rows without Han, adjacent equal rows, rows with a character four times in a row,
    rows of eight or more letters that are nearly all kana, and rows that match each given garble pattern."""
    w = by_file()
    rows = cues.withColumn("dup", F.coalesce(F.col("text") == F.lag("text").over(w), F.lit(False)))
    short = (F.length(T.strip(F.col("text"))) <= 3) & ~F.col("text").rlike(T.HAN)
    norm = T.norm_words(F.col("text"))
    kana = (F.length(norm) >= 8) & ~norm.rlike(T.HAN) & (F.regexp_count(norm, F.lit(T.KANA)) > 0.95 * F.length(norm))
    more = [F.count_if(F.col("text").rlike(p)).alias(name) for name, p in (patterns or {}).items()]
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.avg(short.cast("double")).alias("fragment_ratio"), F.count_if("dup").alias("duplicate_pairs"), F.count_if(F.col("text").rlike(r"(?s)(.)\1{3,}")).alias("repeated"), F.count_if(kana).alias("kana_only"), *more)


def side_by_side(a: DataFrame, b: DataFrame, least_ms: int = 200) -> DataFrame:
    """Rows of two versions one to one: each left row, in order, takes the free right row that overlaps it most. Files are
    cut where neither version has a row, which no pair crosses, so a right row is never used twice."""
    keep = ["file_id", "pos", "start_ms", "end_ms", "text"]
    pairs = interval_join(a.select(*keep), b.select(*keep), ["file_id"]).filter(F.col("overlap_ms") > least_ms).select("file_id", "pos", "r_pos", "overlap_ms")
    w = by_file("start_ms", "end_ms", "side", "pos")
    both = a.select(*keep[:4], F.lit(0).alias("side")).union(b.select(*keep[:4], F.lit(1).alias("side"))).filter("end_ms > start_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    stretch = both.withColumn("stretch", island(F.coalesce(F.col("start_ms") >= reach, F.lit(True)), w)).filter("side = 0").select("file_id", "pos", "stretch")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, served = None, set(), set()
        for batch in batches:
            take = []
            for k, (file_id, part, pos, r_pos) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file_id", "part", "pos", "r_pos")), strict=True)):
                if at != (file_id, part):
                    at, used, served = (file_id, part), set(), set()
                if pos not in served and r_pos not in used:
                    served.add(pos)
                    used.add(r_pos)
                    take.append(k)
            yield batch.take(pa.array(take, pa.int64())).select(["file_id", "pos", "r_pos", "overlap_ms"])

    # Stretches don't touch each other, so a part may hold many of them; parts follow each other in a task, as one stream.
    rows = pairs.join(stretch, ["file_id", "pos"]).select("file_id", F.floor(F.col("stretch") / 1000).alias("part"), *(F.col(c).cast("long").alias(c) for c in ("pos", "r_pos", "overlap_ms")))
    rows = rows.repartition("file_id", "part").sortWithinPartitions("file_id", "part", "pos", F.desc("overlap_ms"), "r_pos")
    return rows.mapInArrow(match, "file_id long, pos long, r_pos long, overlap_ms long")


def label_rows(labels: DataFrame, rows: DataFrame, width_ms: int = 500) -> DataFrame:
    """Labels (prefix, at_ms, label) with the nearest row (prefix, start_ms, pos) within the width or in the same second."""
    near = labels.withColumn("sec", F.explode(F.array(*(F.floor(F.col("at_ms") / 1000) + k for k in (-1, 0, 1)))))
    pairs = near.join(rows.withColumn("sec", F.floor(F.col("start_ms") / 1000)), ["prefix", "sec"])
    gap = F.abs(F.col("at_ms") - F.col("start_ms"))
    pairs = pairs.filter((gap <= width_ms) | (F.floor(F.col("at_ms") / 1000) == F.floor(F.col("start_ms") / 1000))).withColumn("gap", gap)
    w = Window.partitionBy("prefix", "at_ms", "label").orderBy("gap", "pos")
    return pairs.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "sec")


def changed_inputs(current: DataFrame, ledger: DataFrame, prints: tuple[str, ...] = ("input_fp", "config_fp", "glossary_fp", "tm_fp")) -> DataFrame:
    """Files with the reasons to compute them again: fingerprints that differ from the last ledger row, or no row."""
    last = ledger.groupBy("file_id").agg(F.max_by(F.struct(*prints), "seq").alias("last"))
    rows = current.join(last, "file_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("last").isNull(), F.lit("new")), *(F.when(F.col("last").isNotNull() & ~F.col(p).eqNullSafe(F.col(f"last.{p}")), F.lit(p)) for p in prints)))
    return rows.select("file_id", reasons.alias("reasons"))


def confusion(rows: DataFrame, truth: str, guess: str, classes: list[str]) -> DataFrame:
    """Per class: true and false positives, misses, precision and recall (1 where nothing is to be found), and the averages
    of both over the classes on every row."""
    out = rows.select(truth, guess, F.explode(F.array(*map(F.lit, classes))).alias("class")).groupBy("class").agg(
        F.count_if((F.col(truth) == F.col("class")) & (F.col(guess) == F.col("class"))).alias("tp"),
        F.count_if((F.col(truth) != F.col("class")) & (F.col(guess) == F.col("class"))).alias("fp"),
        F.count_if((F.col(truth) == F.col("class")) & (F.col(guess) != F.col("class"))).alias("fn"),
    )
    ratio = lambda d: F.when(d == 0, 1.0).otherwise(F.col("tp") / d)
    out = out.withColumns({"precision": ratio(F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp") + F.col("fn"))})
    whole = Window.partitionBy(F.lit(0))  # a row per class
    return out.withColumns({"macro_precision": F.avg("precision").over(whole), "macro_recall": F.avg("recall").over(whole)})
