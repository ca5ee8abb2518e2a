"""Joins along time: best overlap, two-pass disagreement, scenes, unmatched rows, context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans.islands import band_join, interval_join, neighbours
from cuelake.plans.once import once

#: Review thresholds on similarity, and the lengths that make a pair an artifact (fixed values).
STRICT, OPTIONAL = 0.30, 0.50
SHORT_MOST, LONG_LEAST = 3, 4
#: Replies and interjections that make a pair an artifact when the shorter text is one (fixed values).
INTERJECTIONS = (
    "うん", "うんうん", "うんっ", "はい", "ね", "ねえ", "な", "ん",
    "ああ", "あー", "えっ", "ええ", "ううん", "ふふ", "おっ", "おお", "はぁ",
)


def best_spans(left: DataFrame, right: DataFrame, how: str = "inner", more: tuple[str, ...] = ()) -> DataFrame:
    """left's columns, r_pos, r_start_ms, r_end_ms and overlap_ms: the right row that overlaps a left row most, the first in
    file order on ties. Left rows without overlap are out, or stay with how="left". Of right's other columns only more take
    part, small ones: texts are fetched for what is left."""
    span = ["file_id", "pos", "start_ms", "end_ms"]
    own = [c for c in left.columns if c not in span]
    pairs = interval_join(left, right.select(*span, *more), ["file_id"], how=how)
    best = F.max_by(F.struct("r_pos", "r_start_ms", "r_end_ms", "overlap_ms", *(f"r_{c}" for c in more)), F.when(F.col("overlap_ms").isNotNull(), F.struct("overlap_ms", -F.col("r_pos"))))
    return pairs.groupBy(*span).agg(*(F.first(c).alias(c) for c in own), best.alias("b")).select(*left.columns, "b.*")


def best_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left row with the right row that overlaps it most; none without overlap."""
    texts = right.select("file_id", F.col("pos").alias("r_pos"), F.col("text").alias("r_text"))
    return best_spans(left, right, "left").join(texts, ["file_id", "r_pos"], "left").select(*left.columns, "r_pos", "r_start_ms", "r_end_ms", "overlap_ms", "r_text")


def disagreement(merged: DataFrame, first: DataFrame, second: DataFrame, native: bool = False, texts: bool = True) -> DataFrame:
    """Rows of the merged transcription (file_id, pos and span) that overlap a row of both passes, with these two rows: their IoU,
    the larger difference of their starts or ends, the similarity of their texts and whether the pair is an artifact. native
    takes the Levenshtein ratio instead of matching blocks. Without texts there is no text, similarity or artifact; lengths
    and interjections are those of the passes' rows, so no text travels."""
    sides, span = [], ["file_id", "pos", "start_ms", "end_ms"]
    for k, lane in ((1, first), (2, second)):
        normal = once(lane.select(*span, "text"), norm=T.norm_similarity(F.col("text")))
        normal = normal.withColumns({"size": F.length("norm"), "known": F.col("norm").isin(*INTERJECTIONS)})
        best = best_spans(merged.select(*span), lane if texts else normal, more=() if texts else ("size", "known"))
        own = normal.select("file_id", *(F.col(c).alias(f"{c}{k}") for c in ("pos", "text", "norm", "size", "known")))
        of = ("pos", "start_ms", "end_ms") if texts else ("pos", "start_ms", "end_ms", "size", "known")
        best = best.select("file_id", "pos", *(span[2:] if k == 1 else ()), *(F.col(f"r_{c}").alias(f"{c}{k}") for c in of))
        sides.append(best.join(own, ["file_id", f"pos{k}"]) if texts else best)
    rows = sides[0].join(sides[1], ["file_id", "pos"])
    overlap = F.greatest(F.lit(0), F.least("end_ms1", "end_ms2") - F.greatest("start_ms1", "start_ms2"))
    union = F.col("end_ms1") - F.col("start_ms1") + F.col("end_ms2") - F.col("start_ms2") - overlap
    offset = F.greatest(F.abs(F.col("start_ms1") - F.col("start_ms2")), F.abs(F.col("end_ms1") - F.col("end_ms2")))
    rows = rows.withColumns({"iou": F.bround(F.when(union > 0, overlap / union).otherwise(0.0), 4), "offset_s": F.bround(offset / 1000, 3)})
    interjection = F.when(F.col("size1") <= F.col("size2"), F.col("known1")).otherwise(F.col("known2"))
    rows = rows.withColumns({"short": F.least("size1", "size2"), "long": F.greatest("size1", "size2"), "interjection": interjection}).drop("size1", "size2", "known1", "known2")
    if not texts:
        return rows
    a, b = F.col("norm1"), F.col("norm2")
    rows = rows.withColumn("similarity", T.levenshtein_ratio(a, b) if native else T.seq_ratio(a, b))
    artifact = F.col("interjection") | ((F.col("short") <= SHORT_MOST) & (F.col("long") >= LONG_LEAST) & (F.col("similarity") < STRICT))
    return rows.withColumn("artifact", artifact).drop("norm1", "norm2")


def review_groups(rows: DataFrame) -> DataFrame:
    """must_see, optional, artifact or none."""
    group = F.when(F.col("artifact"), "artifact").when(F.col("similarity") < STRICT, "must_see").when(F.col("similarity") < OPTIONAL, "optional").otherwise("none")
    return rows.withColumn("group", group)


def artifact_sample(rows: DataFrame, n: int = 5) -> DataFrame:
    """The artifacts of a file with the least IoU, then the largest offset; a sample is the feature."""
    w = Window.partitionBy("file_id").orderBy("iou", F.desc("offset_s"), "pos")
    return rows.filter("artifact").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def similarity_buckets(rows: DataFrame) -> DataFrame:
    """Rows and artifacts below the strict threshold, up to the optional one, and above."""
    bucket = F.when(F.col("similarity") < STRICT, "strict").when(F.col("similarity") < OPTIONAL, "mid").otherwise("high")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("artifact").alias("artifacts"))


def threshold_grid(rows: DataFrame, ious: tuple[float, ...] = (0.20, 0.25, 0.30, 0.35), offsets: tuple[float, ...] = (1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """For labelled rows (label A, B or C) and each pair of limits: the share of A, of B and of both that survives, and of C
    that is cleared; null without rows of the label. rule historical: interjections and rows with IoU below and offset above
    their limits are artifacts; rule current: the limits no longer count, interjections alone are artifacts, so all cells
    are alike."""
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("iou_limit"), F.lit(o).alias("offset_limit")) for i in ious for o in offsets)))
    cells = rows.groupBy("label", "iou", "offset_s", "interjection").agg(F.count(F.lit(1)).alias("n")).withColumn("g", grid).select("*", "g.*").withColumn("rule", F.explode(F.array(F.lit("current"), F.lit("historical"))))
    gone = F.col("interjection") | ((F.col("rule") == "historical") & (F.col("iou") < F.col("iou_limit")) & (F.col("offset_s") > F.col("offset_limit")))

    def share(labels: tuple[str, ...], test):
        own = F.col("label").isin(*labels)
        return F.sum(F.when(own, F.when(test, F.col("n")).otherwise(0))) / F.sum(F.when(own, F.col("n")))

    return cells.groupBy("rule", "iou_limit", "offset_limit").agg(share(("A",), ~gone).alias("a_alive"), share(("B",), ~gone).alias("b_alive"), share(("A", "B"), ~gone).alias("ab_alive"), share(("C",), gone).alias("c_cleared"))


def unmatched(left: DataFrame, right: DataFrame, width_ms: int = 2000) -> DataFrame:
    """Left rows without a right row whose midpoint is within width_ms."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    l, r = left.withColumn("mid", mid), right.select("file_id", mid.alias("mid"))
    near = band_join(l.select("file_id", "pos", "mid"), r, ["file_id"], "mid", "mid", width_ms).select("file_id", "pos").distinct()
    return left.join(near, ["file_id", "pos"], "left_anti")


def scene_bounds(scenes: DataFrame) -> DataFrame:
    """Cumulative bounds of scenes in seconds, rounded to microseconds so that neighbours meet."""
    total = F.sum(F.greatest("audio_duration_s", F.lit(0.0))).over(Window.partitionBy("file_id").orderBy("scene"))
    return scenes.withColumn("hi_s", F.round(total, 6)).withColumn("lo_s", F.round(F.col("hi_s") - F.greatest("audio_duration_s", F.lit(0.0)), 6))


def assign_scenes(cues: DataFrame, scenes: DataFrame, closed: bool = True, how_wide: float = 10.0) -> DataFrame:
    """The first scene whose upper bound is not before the cue's midpoint (closed), or the half-open scene that holds it.
    Scenes go to the time buckets they touch; a cue looks into its own."""
    mid = (F.col("start_ms") + F.col("end_ms")) / 2000
    b = scene_bounds(scenes).select("file_id", "scene", "lo_s", "hi_s").filter("hi_s > lo_s")
    b = b.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo_s") / how_wide), F.floor(F.col("hi_s") / how_wide))))
    rows = cues.withColumn("mid_s", mid).withColumn("_b", F.floor(F.col("mid_s") / how_wide))
    inside = (F.col("mid_s") > F.col("lo_s")) & (F.col("mid_s") <= F.col("hi_s")) if closed else (F.col("mid_s") >= F.col("lo_s")) & (F.col("mid_s") < F.col("hi_s"))
    hit = rows.select("file_id", "pos", "mid_s", "_b").join(b, ["file_id", "_b"]).filter(inside | ((F.col("lo_s") == 0) & (F.col("mid_s") <= 0)))
    hit = hit.groupBy("file_id", "pos").agg(F.min("scene").alias("scene"))
    return rows.drop("_b").join(hit, ["file_id", "pos"], "left")


def context_windows(targets: DataFrame, lane: DataFrame, around: int = 5) -> DataFrame:
    """The lane's rows within a number of places of each target row, as one array."""
    near = neighbours(targets.select("file_id", F.col("pos").alias("target")), lane, "target", around, "text").filter(F.size("window") > 0)
    return near.select("file_id", "target", F.col("window.text").alias("context"))


def align_by_start(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with the right row of the same start, in order: a right row is used up by a left row with its exact
    span, while a merged left row (other end) takes the row without using it up."""
    w = Window.partitionBy("file_id", "start_ms")
    sides = []
    for name, df in (("l", left), ("r", right)):
        sides.append(df.groupBy("file_id", "start_ms").agg(F.array_sort(F.collect_list(F.struct("pos", "end_ms", "idx", "text"))).alias(name)))
    both = sides[0].join(sides[1], ["file_id", "start_ms"])  # rows of one start are few
    empty = F.array().cast("array<struct<pos:int,at:int>>")

    def step(acc, l):
        r = F.get(F.col("r"), acc["p"])
        out = F.concat(acc["out"], F.array(F.struct(l["pos"].cast("int").alias("pos"), F.when(r.isNotNull(), acc["p"]).alias("at"))))
        return F.struct((acc["p"] + F.when(r["end_ms"] == l["end_ms"], 1).otherwise(0)).alias("p"), out.alias("out"))

    folded = F.aggregate("l", F.struct(F.lit(0).alias("p"), empty.alias("out")), step, lambda acc: acc["out"])
    found = both.select("file_id", "r", F.explode(folded).alias("m")).select("file_id", F.col("m.pos").alias("pos"), F.get("r", F.col("m.at")).alias("o"))
    found = found.filter("o is not null").select("file_id", "pos", F.col("o.pos").alias("orig_pos"), F.col("o.idx").alias("orig_idx"), F.col("o.text").alias("orig_text"))
    return left.join(found, ["file_id", "pos"], "left")
