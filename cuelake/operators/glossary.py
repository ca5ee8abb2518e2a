"""Glossary: term hits, conflicts, layers, additions, watch log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators.passes import align_by_start
from cuelake.plans.containment import containing

#: Limits of the watch log's verdict (fixed values).
MIN_RUNS, MIN_CANDIDATES, CANDIDATE_CUTOFF, FALSE_RATE = 3, 100, 300, 0.02


def term_hits(rows: DataFrame, glossary: DataFrame, text: str = "text") -> DataFrame:
    """Rows (file_id, pos) with every term they contain. Texts and terms are folded once. Single-word terms meet the rows'
    words in an equi-join; the others (phrases, unspaced scripts) by their rarest gram and are verified. Only ids travel to
    the joins; the rows are fetched for what was hit."""
    folded = rows.select("file_id", "pos", T.fold(F.col(text)).alias("s"))
    words = F.array_distinct(F.regexp_extract_all("s", F.lit(f"{T.LATIN}+"), 0))
    g = glossary.withColumn("t", T.fold(F.col("src")))
    single = F.col("t").rlike(f"^{T.LATIN}+$")
    by_word = folded.select("file_id", "pos", F.explode(words).alias("t")).join(g.filter(single & (F.length("t") >= 2)), "t").drop("t")
    inside = T.contains_folded(F.col("t"), F.col("s"))
    by_gram = containing(folded, g.filter(~single).select("src", "t").distinct(), ["file_id", "pos"], "src", inside).drop("t").join(glossary, "src")
    hits = by_word.select("file_id", "pos", *glossary.columns).unionByName(by_gram.select("file_id", "pos", *glossary.columns))
    return rows.join(hits, ["file_id", "pos"])


def injected_terms(rows: DataFrame, glossary: DataFrame, most: int = 100) -> DataFrame:
    """The terms that a batch of rows (file_id, scene, batch, pos, text) brings along, at most most of them in order of
    the glossary, and how many were hit in all."""
    hits = term_hits(rows, glossary).select("file_id", "scene", "batch", "src", "dst", "ord").distinct()
    w = Window.partitionBy("file_id", "scene", "batch")
    hits = hits.withColumns({"place": F.row_number().over(w.orderBy("ord", "src", "dst")), "hits": F.count(F.lit(1)).over(w)})
    return hits.filter(F.col("place") <= most)


def conflict_distribution(conflicts: DataFrame, top: int = 10) -> DataFrame:
    """The terms with the most conflicts."""
    return conflicts.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(top)


def merge_terms(glossary: DataFrame) -> DataFrame:
    """One row per src: the first dst, all other translations and aliases as one set in order."""
    rows = glossary.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst", "aliases"))).alias("a"))  # translations of one term
    flat = F.flatten(F.transform("a", lambda x: F.concat(F.array(x["dst"]), x["aliases"])))
    return rows.select("src", F.element_at("a", 1)["dst"].alias("dst"), F.array_except(F.array_distinct(flat), F.array(F.element_at("a", 1)["dst"])).alias("aliases"))


def conflicts(final: DataFrame, orig: DataFrame, glossary: DataFrame) -> DataFrame:
    """Every term hit in a source row: whether the aligned target has its translation, an alias, or neither."""
    rows = align_by_start(final, orig).filter("orig_text is not null and trim(orig_text) <> ''")
    hits = term_hits(rows, merge_terms(glossary), "orig_text")
    alias = F.exists("aliases", lambda a: (a != "") & F.contains(F.col("text"), a))
    verdict = F.when(F.contains("text", "dst"), "main").when(alias, "alias").otherwise("neither")
    return hits.withColumn("verdict", verdict)


def term_stats(hits: DataFrame, samples: int = 3) -> DataFrame:
    """Per term the counts by verdict and the first rows with neither form."""
    missed = F.when(F.col("verdict") == "neither", 1)
    w = Window.partitionBy("src").orderBy(missed.asc_nulls_last(), "file_id", "pos")
    rows = hits.withColumn("rank", F.row_number().over(w))
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("verdict") == "main").alias("with_main"), F.count_if(F.col("verdict") == "alias").alias("with_alias"), F.count_if(F.col("verdict") == "neither").alias("with_neither"), F.array_sort(F.collect_list(F.when((F.col("verdict") == "neither") & (F.col("rank") <= samples), F.struct("file_id", "pos")))).alias("samples"))


def precedence(glossary: DataFrame, order: tuple[str, ...] = ("override", "user", "learned")) -> DataFrame:
    """All rows with kept: the first layer that has a term wins; the last layer keeps its first row only."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    rows = glossary.withColumn("layer_rank", rank)
    best = F.min("layer_rank").over(Window.partitionBy("src"))
    place = F.row_number().over(Window.partitionBy("src", "layer").orderBy("ord"))
    kept = (F.col("layer_rank") == best) & ((F.col("layer_rank") < len(order)) | (place == 1))
    return rows.withColumn("kept", kept).drop("layer_rank")


def append(glossary: DataFrame, additions: DataFrame) -> DataFrame:
    """Additions (src, dst, ord) with status added, exists or exists_diff against the glossary and the batch itself."""
    fold = lambda c: F.lower(F.trim(c))
    old = glossary.groupBy(fold(F.col("src")).alias("key")).agg(F.collect_set("dst").alias("known"))
    rows = additions.withColumn("key", fold(F.col("src")))
    place = Window.partitionBy("key").orderBy("ord")
    rows = rows.withColumns({"first_dst": F.first("dst").over(place), "place": F.row_number().over(place)}).join(old, "key", "left")
    status = F.when(F.array_contains("known", F.col("dst")), "exists").when(F.col("known").isNotNull(), "exists_diff").when(F.col("place") == 1, "added").when(F.col("first_dst") == F.col("dst"), "exists").otherwise("exists_diff")
    return rows.select("src", "dst", "ord", status.alias("status"))


def reset(learned: DataFrame, keep: DataFrame) -> DataFrame:
    """Learned terms with kept: whether their folded form is on the keep-list."""
    keys = keep.select(F.lower(F.trim("src")).alias("key")).distinct().withColumn("kept", F.lit(True))
    rows = learned.withColumn("key", F.lower(F.trim("src"))).join(keys, "key", "left").drop("key")
    return rows.withColumn("kept", F.coalesce("kept", F.lit(False)))


def evaluate_watch(log: DataFrame, protected: tuple[str, ...] = ("name", "address")) -> DataFrame:
    """One verdict from watch records (date, per_term map<string,struct<candidates,conflicts>>, manual_fp
    map<string,struct<count,category>>): insufficient, ready or not_ready."""
    total = lambda m, f: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[f], F.lit(0)))
    guarded = F.aggregate(F.map_values("manual_fp"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["category"].isin(*protected), F.coalesce(x["count"], F.lit(0))).otherwise(0))
    rows = log.select(total("per_term", "candidates").alias("c"), total("per_term", "conflicts").alias("x"), total("manual_fp", "count").alias("fp"), guarded.alias("g"))
    sums = rows.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("c"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("x"), F.lit(0)).alias("conflicts"), F.coalesce(F.sum("fp"), F.lit(0)).alias("false_positives"), F.coalesce(F.sum("g"), F.lit(0)).alias("protected"))
    rate = F.when(F.col("conflicts") > 0, F.col("false_positives") / F.col("conflicts")).otherwise(0.0)
    few = (F.col("runs") >= MIN_RUNS) & (F.col("candidates") < MIN_CANDIDATES)
    ready = ((F.col("runs") >= MIN_RUNS) | (F.col("candidates") >= CANDIDATE_CUTOFF)) & (rate < FALSE_RATE) & (F.col("protected") == 0)
    return sums.withColumns({"rate": rate, "advice": F.when(few, "insufficient").when(ready, "ready").otherwise("not_ready")})
