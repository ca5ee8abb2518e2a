"""Quality measures of final cues: speech rate, line length, gaps, coverage, length ratio, totals and guide items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans.islands import by_file

CPS_CJK, CPS_OTHER, CPS_TOLERANCE, CPS_LEAST_S = 8.0, 20.0, 1.15, 0.5
LINE_LIMIT, GAP_S = 30, 5.0


def _pos(extra=()):
    return by_file("start_ms", "end_ms", "pos", *extra)


def with_cps(cues: DataFrame) -> DataFrame:
    """compact text, chars, seconds and cps; cps is null for empty, untimed and very short rows."""
    rows = cues.withColumn("compact", T.compact(F.col("text")))
    rows = rows.withColumns({"chars": F.length("compact"), "seconds": (F.col("end_ms") - F.col("start_ms")) / 1000})
    return rows.withColumn("cps", F.when((F.col("chars") > 0) & (F.col("seconds") >= CPS_LEAST_S), F.col("chars") / F.col("seconds")))


def cps_observations(cues: DataFrame) -> DataFrame:
    """Rows faster than the base rate of their script, with tolerance."""
    base = F.when(T.cjk_dominant(F.col("compact")), CPS_CJK).otherwise(CPS_OTHER)
    rows = with_cps(cues).withColumn("cps_limit", base * CPS_TOLERANCE)
    return rows.filter(F.col("cps") > F.col("cps_limit")).drop("compact")


def cps_actions(cues: DataFrame, threshold: float = 5.0, top: int = 20, cjk_only: bool = True) -> DataFrame:
    """The fastest rows of each file above a threshold, and whether more were cut off."""
    rows = with_cps(cues).filter(F.col("cps") > threshold)
    rows = rows.filter(T.cjk_dominant(F.col("compact"))) if cjk_only else rows
    w = Window.partitionBy("file_id")
    rows = rows.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("cps"), "pos")), "truncated": F.count(F.lit(1)).over(w) > top})
    return rows.filter(F.col("rank") <= top).drop("compact")


def cps_distribution(cues: DataFrame, by: str = "lang", limit: float = CPS_OTHER * CPS_TOLERANCE) -> DataFrame:
    """Per group and over all: rows, mean, nearest-rank percentiles, maximum, rows skipped and rows over the limit."""
    rows = with_cps(cues)
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by cps)")
    return rows.rollup(by).agg(
        F.count("cps").alias("n"), F.avg("cps").alias("mean_cps"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.max("cps").alias("max_cps"),
        F.count_if(F.col("cps").isNull()).alias("skipped"), F.count_if(F.col("cps") > limit).alias("over_limit"),
    )


def long_lines(cues: DataFrame, limit: int = LINE_LIMIT, whitelist: Column | None = None) -> DataFrame:
    """Rows with a line of more than limit characters without white space: the longest such line, the first on ties."""
    rows = cues if whitelist is None else cues.filter(~whitelist)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(F.length(T.compact(x)).alias("n"), (-i).alias("i"), T.strip(x).alias("line")))
    rows = rows.withColumn("worst", F.array_max(lines)).filter(F.col("worst.n") > limit)
    return rows.withColumns({"max_len": F.col("worst.n"), "excerpt": F.substring("worst.line", 1, 60)}).drop("worst")


def gap_observations(cues: DataFrame, least_s: float = GAP_S) -> DataFrame:
    """Pauses between neighbours in time order of more than least_s, and the file's longest pause."""
    rows = cues.filter("start_ms is not null").withColumns({"prev_idx": F.lag("idx").over(_pos()), "prev_end_ms": F.lag("end_ms").over(_pos())})
    rows = rows.withColumn("gap_ms", F.col("start_ms") - F.col("prev_end_ms"))
    rows = rows.withColumn("max_gap_ms", F.max("gap_ms").over(Window.partitionBy("file_id")))
    return rows.filter(F.col("gap_ms") > least_s * 1000)


def overlap_repair(cues: DataFrame) -> DataFrame:
    """Starts move to the end of the row before; ends never move."""
    w = by_file("start_ms", "end_ms", "pos")
    return cues.withColumn("new_start_ms", F.greatest("start_ms", F.coalesce(F.lag("end_ms").over(w), F.col("start_ms"))))


def alignment(final: DataFrame, orig: DataFrame) -> DataFrame:
    """Per file: rows of the final version whose span exists in the original, and their rate."""
    spans = orig.select("file_id", "start_ms", "end_ms").distinct().withColumn("hit", F.lit(True))
    rows = final.join(spans, ["file_id", "start_ms", "end_ms"], "left")
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("aligned"), (F.count("hit") / F.count(F.lit(1))).alias("rate"))


def coverage(final: DataFrame, orig: DataFrame) -> DataFrame:
    """Original rows without a translation: missing altogether, or there but untranslated in every row of the span."""
    spans = final.groupBy("file_id", "start_ms", "end_ms").agg(F.every(T.is_untranslated(F.col("text"))).alias("untranslated"))
    rows = orig.join(spans, ["file_id", "start_ms", "end_ms"], "left")
    state = F.when(F.col("untranslated").isNull(), "missing").when(F.col("untranslated"), "untranslated").otherwise("covered")
    return rows.withColumn("state", state)


def length_ratio(final: DataFrame, orig: DataFrame, low: float = 0.3) -> DataFrame:
    """Per file: the upper median of target over source weighted length, and the share of very short targets."""
    src = orig.groupBy("file_id", "start_ms", "end_ms").agg(F.min_by("text", "pos").alias("source"))  # the first row of a span
    rows = final.join(src, ["file_id", "start_ms", "end_ms"]).filter(~T.is_untranslated(F.col("text")))
    rows = rows.withColumn("ratio", T.weighted_length(F.col("text")) / T.weighted_length(F.col("source")))
    ratios = F.array_sort(F.collect_list("ratio"))
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.element_at(ratios, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median_ratio"), F.avg((F.col("ratio") < low).cast("int")).alias("low_share"))


def placeholder_stats(final: DataFrame) -> DataFrame:
    text = T.strip(F.coalesce("text", F.lit("")))
    return final.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(T.is_untranslated(F.col("text"))).alias("untranslated"), F.count_if(text == "").alias("empty"), F.count_if(text.rlike(r"^[-—–]+$")).alias("dashes"))


def residue(final: DataFrame, orig: DataFrame, pattern: str = T.KANA) -> DataFrame:
    """Runs of source script left in the target, per row that isn't marked untranslated, and whether the source of its span
    has all of them, some or none."""
    src = orig.groupBy("file_id", "start_ms", "end_ms").agg(F.min_by(T.strip(F.coalesce("text", F.lit(""))), "pos").alias("source"))
    rows = final.filter(~T.is_untranslated(F.col("text"))).withColumn("fragments", F.regexp_extract_all("text", F.lit(f"({pattern}+)"), 1)).filter(F.size("fragments") > 0)
    rows = rows.join(src, ["file_id", "start_ms", "end_ms"], "left").withColumn("source", F.coalesce("source", F.lit("")))
    found = F.size(F.filter("fragments", lambda x: F.contains(F.col("source"), x)))
    note = F.when(found == F.size("fragments"), "all").when(found > 0, "some").otherwise("none")
    return rows.withColumns({"residue_chars": F.aggregate("fragments", F.lit(0), lambda a, x: a + F.length(x)), "in_source": note}).drop("source")


def term_retention(final: DataFrame, orig: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Of source rows with a listed term, the share whose target has its translation. Terms are few and given."""
    src = orig.groupBy("file_id", "start_ms", "end_ms").agg(F.min_by("text", "pos").alias("source"))  # the first row of a span
    rows = src.join(final.select("file_id", "start_ms", "end_ms", "text"), ["file_id", "start_ms", "end_ms"], "left")
    stacked = F.array(*(F.struct(F.lit(a).alias("term"), F.lit(b).alias("target")) for a, b in terms))
    rows = rows.select("*", F.explode(stacked).alias("t")).filter(F.contains("source", F.col("t.term")))
    return rows.groupBy("t.term").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.contains(F.coalesce("text", F.lit("")), F.col("t.target"))).alias("kept"))


def identity(original: DataFrame, **counts: DataFrame) -> DataFrame:
    """Per file the rows of each stage counter (frames with file_id) and whether they add up to the original rows."""
    parts = [original.select("file_id", F.lit("n").alias("stage"))] + [df.select("file_id", F.lit(k).alias("stage")) for k, df in counts.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    out = rows.groupBy("file_id").agg(*(F.count_if(F.col("stage") == k).alias(k) for k in ("n", *counts)))
    return out.withColumn("balanced", F.col("n") == sum((F.col(k) for k in counts), F.lit(0)))


def guide_items(final: DataFrame, orig: DataFrame, warnings: DataFrame | None = None, missed_speech: DataFrame | None = None) -> DataFrame:
    """One table of what a reviewer should see: warnings (file_id, idx, timing, category, message), untranslated rows, long
    lines, missed speech (file_id, idx, timing, message; an observation) and fast rows, with status, the current text of
    the index's first final row and 40 characters of the source. place orders a file's items by index, null last."""
    current = final.groupBy("file_id", "idx").agg(F.min_by("text", "pos").alias("now"))
    source = orig.groupBy("file_id", "idx").agg(F.substring(F.coalesce(F.min_by("text", "pos"), F.lit("")), 1, 40).alias("src"))

    def item(df, category, message, status="open", text=None, excerpt=None):
        one = lambda c: F.lit(None).cast("string") if c is None else c
        return df.select("file_id", F.col("idx").cast("long").alias("idx"), F.coalesce(F.col("timing"), F.lit("")).alias("timing"), category.alias("category"), message.alias("message"), F.lit(status).alias("status"), one(text).alias("own"), one(excerpt).alias("excerpt"))

    u = F.lit("untranslated")
    parts = [
        item(final.filter(T.is_untranslated(F.col("text"))), u, F.lit("left untranslated"), text=F.col("text")),
        item(long_lines(final), F.lit("single_line_too_long"), F.concat(F.lit("line of "), F.col("max_len").cast("string")), excerpt=F.col("excerpt")),
        item(cps_actions(final, CPS_OTHER * CPS_TOLERANCE, cjk_only=False), F.lit("cps_too_fast"), F.concat(F.lit("rank "), F.col("rank").cast("string")), excerpt=F.lit("")),
    ]
    if warnings is not None:
        parts.append(item(warnings, F.col("category"), F.col("message")))
    if missed_speech is not None:
        parts.append(item(missed_speech, F.lit("suspected_missed_speech"), F.col("message"), "observation", excerpt=F.lit("")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.join(current, ["file_id", "idx"], "left").join(source, ["file_id", "idx"], "left")
    text = F.when(F.col("status") == "observation", F.lit(None)).otherwise(F.coalesce("own", "now"))
    w = Window.partitionBy("file_id").orderBy(F.asc_nulls_last("idx"), "category", "message", "timing")
    return out.withColumns({"current_text": text, "source_excerpt": F.coalesce("excerpt", "src", F.lit("")), "place": F.row_number().over(w)}).drop("own", "now", "src", "excerpt")


def final_rows(final: DataFrame, indexes: DataFrame) -> DataFrame:
    """Indexes (file_id, idx) of a report with the final row they mean: the first in file order with exactly that index, or
    nothing; neighbours are never guessed."""
    first = final.groupBy("file_id", "idx").agg(F.min_by(F.struct("pos", "start_ms", "end_ms", "text"), "pos").alias("r"))
    return indexes.join(first, ["file_id", "idx"], "left").select(*indexes.columns, "r.pos", "r.start_ms", "r.end_ms", "r.text")


def recompute(final: DataFrame, merged: DataFrame) -> DataFrame:
    """Per file, from the two versions alone: rate of final rows whose span is in the merged version, merged rows with Han
    and those of them without a final row, upper median of the length ratio and the share below 0.3."""
    span = ["file_id", "start_ms", "end_ms"]
    said = final.withColumn("t", T.strip(F.coalesce("text", F.lit("")))).groupBy(*span).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("said"))  # rows of one span
    rows = merged.select(*span, T.strip(F.coalesce("text", F.lit(""))).alias("s")).join(said, span, "left")
    ratio = F.when((F.col("s") != "") & (F.col("said") != ""), T.weighted_length(F.col("said")) / F.greatest(F.lit(1.0), T.weighted_length(F.col("s"))))
    rows = rows.withColumns({"ratio": ratio, "han": F.col("s").rlike(r"[\x{4e00}-\x{9fff}々]")})
    out = rows.groupBy("file_id").agg(F.count_if("han").alias("content_rows"), F.count_if(F.col("han") & F.col("said").isNull()).alias("missed"), F.get(F.sort_array(F.collect_list("ratio")), F.floor(F.count("ratio") / 2).cast("int")).alias("median_ratio"), F.avg((F.col("ratio") < 0.3).cast("double")).alias("low_share"))
    spans = merged.select(*span).distinct().withColumn("hit", F.lit(True))
    aligned = final.join(spans, span, "left").groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("aligned"))
    return out.join(aligned, "file_id", "full_outer").withColumn("align_rate", F.when(F.col("rows") > 0, F.col("aligned") / F.col("rows")))


def rejoined(normal: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that went through a filter and rows kept as they are, one table again in time order: pos is the new place."""
    rows = normal.unionByName(kept)
    return rows.withColumn("pos", F.row_number().over(_pos(("idx",))) - 1)


def risk_rollup(events: DataFrame, samples: int = 3) -> DataFrame:
    """Per task, phase and type: first and last seq, count and the first few seqs."""
    rank = F.row_number().over(Window.partitionBy("task_id", "phase", "type").orderBy("seq"))
    rows = events.withColumn("rank", rank)
    return rows.groupBy("task_id", "phase", "type").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= samples, F.col("seq")))).alias("samples"))


def risk_events(rows: DataFrame, samples: int = 3) -> DataFrame:
    """Rows (file_id, idx, timing, stage, reason, action, severity) as risk events: the range of indexes, the first and
    last timing, the rows affected and the first few timings."""
    rank = F.row_number().over(Window.partitionBy("file_id", "stage", "reason", "action", "severity").orderBy("idx", "timing"))
    few = F.array_sort(F.collect_list(F.when(F.col("rank") <= samples, F.struct("rank", "timing"))))
    out = rows.withColumn("rank", rank).groupBy("file_id", "stage", "reason", "action", "severity").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.min_by("timing", "rank").alias("first_timing"), F.max_by("timing", "rank").alias("last_timing"), F.count(F.lit(1)).alias("affected"), F.transform(few, lambda x: x["timing"]).alias("timings"))
    span = F.when(F.col("lo").isNull(), "").when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return out.select("file_id", "stage", "reason", "action", "severity", span.alias("entry_range"), F.concat_ws("→", "first_timing", "last_timing").alias("timing_range"), "affected", "timings")


def majority_events(files: DataFrame) -> DataFrame:
    """The critical event of each file (file_id, total, kept, untranslated_majority) of which most is untranslated."""
    rows = files.filter("untranslated_majority")
    reason = F.concat(F.lit("untranslated majority: "), F.col("kept").cast("string"), F.lit("/"), F.col("total").cast("string"))
    empty = F.lit("")
    return rows.select("file_id", F.lit("final").alias("stage"), reason.alias("reason"), F.lit("kept source").alias("action"), F.lit("critical").alias("severity"), empty.alias("entry_range"), empty.alias("timing_range"), F.greatest(F.lit(0), F.col("total") - F.col("kept")).cast("long").alias("affected"), F.array().cast("array<string>").alias("timings"))


def risk_files(events: DataFrame, totals: DataFrame, majority: float = 0.8) -> DataFrame:
    """Per file (totals: file_id, total, kept: rows left in the source language) events by severity, untranslated_majority
    (kept is at least that share of all; a critical event of its own), and degraded: an event that isn't just information
    acted on rows, or a majority."""
    is_ = lambda name: F.count_if(F.col("severity") == name).alias(name)
    acted = F.coalesce(F.bool_or((F.col("severity") != "info") & (F.col("action") != "") & (F.col("affected") > 0)), F.lit(False))
    sums = events.groupBy("file_id").agg(is_("info"), is_("warning"), is_("critical"), acted.alias("acted"))
    rows = totals.join(sums, "file_id", "left").withColumn("untranslated_majority", (F.col("total") > 0) & (F.col("kept") >= majority * F.col("total")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("info", "warning")} | {"critical": F.coalesce("critical", F.lit(0)) + F.col("untranslated_majority").cast("int")}
    return rows.withColumns(zero | {"degraded": F.coalesce("acted", F.lit(False)) | F.col("untranslated_majority")}).drop("acted")


def run_totals(files: DataFrame) -> DataFrame:
    """Per run (run, failed, degraded): files that went well, of these degraded ones, and files that failed."""
    ok = ~F.col("failed")
    return files.groupBy("run").agg(F.count_if(ok).alias("files_ok"), F.count_if(ok & F.col("degraded")).alias("files_degraded"), F.count_if("failed").alias("files_failed"))
