"""Translation memory: lookups (exact, fuzzy, full-text), upsert, promotion, purge, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans import versions as V
from cuelake.plans.containment import containing, few, first_containing
from cuelake.plans.once import once

KEY = ["content_hash", "stage", "source_lang", "target_lang"]
#: The direction of rows that don't name one.
SOURCE_LANG, TARGET_LANG = "ja", "zh"
TM = "id long, content_hash string, source_text string, target_text string, stage int, char_count int, hit_count long, created_at timestamp, source_name string, source_lang string, target_lang string"


def directed(df: DataFrame) -> DataFrame:
    """The frame with its languages; those it lacks are the default ones."""
    for name, default in (("source_lang", SOURCE_LANG), ("target_lang", TARGET_LANG)):
        df = df.withColumn(name, F.coalesce(name, F.lit(default)) if name in df.columns else F.lit(default))
    return df


def lookup_exact(queries: DataFrame, tm: DataFrame) -> DataFrame:
    """Queries (text, stage, languages or the default ones) with the memory's target. Equal texts are looked up once, so
    frequent replies make no hot key."""
    hashed = directed(queries.withColumn("content_hash", T.content_hash(F.col("text"))))
    hits = hashed.select(*KEY).distinct().join(directed(tm).select(*KEY, "id", "target_text"), KEY)
    return hashed.join(hits, KEY, "left")


def lookup_stages(queries: DataFrame, tm: DataFrame) -> DataFrame:
    """Queries (text) with targets, a map of the memory's target by stage; empty where the memory doesn't know the text."""
    key = [k for k in KEY if k != "stage"]
    hashed = directed(queries.withColumn("content_hash", T.content_hash(F.col("text"))))
    known = directed(tm).join(hashed.select(*key).distinct(), key, "left_semi")
    stages = known.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "target_text")))).alias("targets"))  # a row per stage
    none = F.map_from_entries(F.array().cast("array<struct<stage:int,target_text:string>>"))
    return hashed.join(stages, key, "left").withColumn("targets", F.coalesce("targets", none))


def known(queries: DataFrame, tm: DataFrame) -> DataFrame:
    """Those queries (text, stage) that the memory has."""
    hashed = directed(queries.withColumn("content_hash", T.content_hash(F.col("text"))))
    return hashed.join(directed(tm).select(*KEY), KEY, "left_semi")


def lookup_fuzzy(queries: DataFrame, tm: DataFrame, threshold: float = 0.8, candidates: int = 200, top: int = 10) -> DataFrame:
    """For each query (query_id, text, stage): entries of its stage and direction within half of its length, of these the
    most used, of these the most alike by character sets, capitals and runs of white space aside. Ties of the cut go to
    the smaller id. Of every length only the most used entries can be among the most used of all lengths, so the memory
    is cut to these first, and the candidates are picked once for all queries of a length: a query meets a bounded
    number of entries however large the memory is."""
    key = [k for k in KEY if k != "content_hash"]
    q = directed(queries).select("query_id", *key, F.lower(T.norm_spaces(F.col("text"))).alias("text")).filter("text <> ''").withColumn("n", F.length("text"))
    most = Window.partitionBy(*key, "char_count").orderBy(F.desc("hit_count"), "id")
    e = directed(tm).select("id", *key, "char_count", "hit_count", F.lower(T.norm_spaces(F.col("source_text"))).alias("source")).withColumn("k", F.row_number().over(most)).filter(F.col("k") <= candidates).drop("k")
    lengths = F.sequence(F.greatest(F.lit(1), F.floor(F.col("n") * 0.5)).cast("int"), F.greatest(F.lit(1), F.floor(F.col("n") * 1.5)).cast("int"))
    near = q.select(*key, "n").distinct().withColumn("char_count", F.explode(lengths)).join(e.drop("source"), [*key, "char_count"])
    used = Window.partitionBy(*key, "n").orderBy(F.desc("hit_count"), "id")
    near = near.withColumn("k", F.row_number().over(used)).filter(F.col("k") <= candidates).select(*key, "n", "id")
    pairs = q.join(near, [*key, "n"]).join(e.select("id", "hit_count", "source"), "id")
    pairs = pairs.withColumn("similarity", T.char_jaccard(F.col("text"), F.col("source"))).filter(F.col("similarity") >= threshold)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("hit_count"), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "id", "similarity", "rank")


def probe(queries: DataFrame, tm: DataFrame) -> DataFrame:
    """For each query (query_id, text) the first entry (by id) with an equal text, else with an equal normalised text, else
    with the text inside it: match exact, normalised or like; no row without any. Queries and what each step finds are made
    once. Where they are few, counted, all tasks get them and the memory stays where it is; else containment pairs meet by
    the rarest gram of the query."""
    q = V.settled(queries.select("query_id", "text", T.content_hash(F.col("text")).alias("h"), T.norm_match(F.col("text")).alias("norm"), T.norm_spaces(F.col("text")).alias("like")))
    sent = few(q, "text")
    near = F.broadcast if sent else lambda df: df
    first = lambda df, name: V.settled(df.groupBy("query_id").agg(F.min("id").alias("id")).withColumn("match", F.lit(name)))
    exact = first(near(q).join(tm.select("id", F.col("content_hash").alias("h")), "h"), "exact")
    rest = q.join(exact, "query_id", "left_anti").filter("norm <> ''")
    same = first(near(rest).join(tm.select("id", T.norm_match(F.col("source_text")).alias("norm")), "norm"), "normalised")
    rest = q.join(exact.union(same), "query_id", "left_anti").select("query_id", F.col("like").alias("t"))
    texts = tm.select("id", F.col("source_text").alias("s"))
    like = first(first_containing(texts, rest, "query_id") if sent else containing(texts, rest, ["id"], "query_id"), "like")
    return exact.union(same).union(like).select("query_id", "match", "id")


def upsert(tm: DataFrame, batch: DataFrame, top: int | None = None) -> DataFrame:
    """The next version of the memory, all its columns. batch: source_text, target_text, stage, created_at, source_name,
    ord, and languages or the default ones. Texts are folded to single spaces; rows with an empty side are ignored. Of a
    batch's rows with a key the last (by ord) gives the texts, the first its creation time; existing rows keep id, creation time and hit count;
    provenance stays where the batch has none. New rows are numbered on from the largest id (top, where tm is only a part)
    in order of their keys, by counts of 4,096 hash prefixes, so no task sees all of them."""
    rows = directed(batch).withColumns({"source_text": T.norm_spaces(F.col("source_text")), "target_text": T.norm_spaces(F.col("target_text"))}).filter("source_text <> '' and target_text <> ''")
    rows = rows.withColumn("content_hash", T.content_hash(F.col("source_text")))
    last = F.max_by(F.struct("source_text", "target_text"), "ord").alias("b")
    new = rows.groupBy(*KEY).agg(last, F.max_by("source_name", F.when(F.col("source_name").isNotNull(), F.col("ord"))).alias("name"), F.min_by("created_at", "ord").alias("at"))
    both = directed(tm).join(new, KEY, "full_outer")
    old = both.filter("id is not null")
    fresh = both.filter("id is null").withColumn("prefix", F.substring("content_hash", 1, 3))
    largest = tm.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")) if top is None else tm.sparkSession.range(1).select(F.lit(top).cast("long").alias("top"))  # one row
    counts = fresh.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("prefix")) - F.col("n")).drop("n")  # at most 4,096 rows
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(*KEY))
    fresh = fresh.join(F.broadcast(before), "prefix").crossJoin(F.broadcast(largest)).withColumn("id", F.col("top") + F.col("before") + place).drop("prefix", "before", "top")
    source = F.coalesce("b.source_text", "source_text")
    return old.unionByName(fresh).select("id", "content_hash", source.alias("source_text"), F.coalesce("b.target_text", "target_text").alias("target_text"), "stage", F.length(source).alias("char_count"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("created_at", "at").alias("created_at"), F.coalesce("name", "source_name").alias("source_name"), "source_lang", "target_lang")


def apply_suggestions(tm: DataFrame, suggestions: DataFrame, watch: DataFrame) -> DataFrame:
    """Suggested pairs (source, target, ord) for the upsert, with status added or exists (in the memory or earlier in the
    batch) and conflict_warn: the source is a term with conflicts in the watch log that nobody marked as false."""
    rows = directed(suggestions.withColumns({"source": T.strip(F.col("source")), "target": T.strip(F.col("target"))}).filter("source <> '' and target <> ''").withColumn("stage", F.lit(0)))
    rows = rows.withColumn("content_hash", T.content_hash(F.col("source")))
    there = directed(tm).select(*KEY).distinct().withColumn("there", F.lit(True))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("ord"))
    rows = rows.withColumn("place", place).join(there, KEY, "left")
    terms = watch.select(F.explode("per_term").alias("term", "v"), "manual_fp").filter(F.col("v.conflicts") > 0).filter(~F.coalesce(F.map_contains_key("manual_fp", F.col("term")), F.lit(False))).select("term").distinct()
    open_ = terms.withColumn("warn", F.lit(True))
    lower = F.when(F.col("source").rlike(r"^[\x00-\x7f]*$"), F.lower("source"))
    rows = rows.withColumn("low", lower).join(open_.select(F.col("term").alias("source"), F.col("warn").alias("w1")), "source", "left").join(open_.select(F.col("term").alias("low"), F.col("warn").alias("w2")), "low", "left")
    return rows.select("source", "target", "ord", F.when(F.col("there").isNotNull() | (F.col("place") > 1), "exists").otherwise("added").alias("status"), (F.col("w1").isNotNull() | F.col("w2").isNotNull()).alias("conflict_warn"))


def count_hits(tm: DataFrame, hits: DataFrame) -> DataFrame:
    """One more hit for every entry that a batch found, however often."""
    found = hits.select("id").distinct().withColumn("hit", F.lit(1))
    return tm.join(found, "id", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("hit", F.lit(0))).drop("hit")


def promote(target: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and rows whose (hash, stage) is there already."""
    key = ["content_hash", "stage"]
    return entries.join(target.select(*key), key, "left_anti"), entries.join(target.select(*key), key, "left_semi")


def backup(tm: DataFrame, path: str) -> DataFrame:
    """A copy of the memory under path, read back."""
    tm.write.parquet(path)
    return tm.sparkSession.read.parquet(path)


def promoted(target: DataFrame, entries: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """The target's next version with the new rows appended, after a backup under path; a dry run gives the target as it is."""
    if dry_run:
        return target
    saved = backup(target, path)
    new, _ = promote(saved, entries)
    return saved.unionByName(new.select(*saved.columns))


def purge_candidates(cues: DataFrame, merged: DataFrame) -> DataFrame:
    """text, name and form of what a purge looks for: the source rows of files, and rows that merging made of them.
    Both frames have file_id, text and name, the file's stem."""
    rows = cues.select(T.strip(F.col("text")).alias("text"), "name", F.lit("raw").alias("form")).unionByName(merged.select(T.strip(F.col("text")).alias("text"), "name", F.lit("premerge").alias("form")))
    return rows.filter("text <> ''").distinct()


def purge_plan(tm: DataFrame, candidates: DataFrame, since=None, until=None, unknown_time: bool = False, exclude: DataFrame | None = None) -> DataFrame:
    """Entries that candidates (text, name, form) match by content hash, raw or premerge, or by normalised text, with the
    best form as match. Entries outside the time window (both ends in it) aren't planned; action is would_delete,
    would_keep_unknown_time (no creation time, a window is given, unknown_time is not) or would_keep_excluded. Unless
    one of the matching candidates comes from the entry's own file, the entry is suspicious."""
    digest = F.when(F.col("marks") != "", T.content_hash(F.col("marks"))).alias("norm")
    matched = lambda df, text: once(df.withColumn("nfkc", T.nfkc(F.col(text))), marks=T.norm_marks(F.col("nfkc")))
    c = matched(candidates, "text")
    c = V.settled(c.select(T.content_hash(F.col("text")).alias("h"), digest, F.col("name").alias("source_name"), "form"))  # five steps read it; texts stay behind
    unknown = F.col("created_at").isNull()
    window = since is not None or until is not None
    rows = tm
    if window:
        inside = F.lit(True)
        if since is not None:
            inside = inside & (F.col("created_at") >= since)
        if until is not None:
            inside = inside & (F.col("created_at") <= until)
        rows = rows.filter(unknown | inside)
    rows = matched(rows, "source_text").select("id", "stage", "source_name", unknown.alias("unknown"), F.col("content_hash").alias("h"), digest)
    forms = c.groupBy("h").agg(F.bool_or(F.col("form") == "raw").alias("raw"), F.bool_or(F.col("form") == "premerge").alias("premerge"))
    rows = rows.join(forms, "h", "left").join(c.filter("norm is not null").select("norm").distinct().withColumn("normalized", F.lit(True)), "norm", "left")
    match = F.when(F.col("raw"), "raw").when(F.col("premerge"), "premerge").when(F.col("normalized"), "normalized")
    rows = rows.withColumn("match", match).filter("match is not null")
    for key, flag in (("h", "own_h"), ("norm", "own_norm")):
        own = c.filter(F.col(key).isNotNull()).select(key, "source_name").distinct().withColumn(flag, F.lit(True))
        rows = rows.join(own, [key, "source_name"], "left")
    action = F.when(F.col("unknown") & F.lit(window and not unknown_time), "would_keep_unknown_time").otherwise("would_delete")
    if exclude is not None:
        rows = rows.join(exclude.select("id").distinct().withColumn("hold", F.lit(True)), "id", "left")
        action = F.when(F.col("hold"), "would_keep_excluded").otherwise(action)
    return rows.select("id", "stage", "match", action.alias("action"), (F.col("own_h").isNull() & F.col("own_norm").isNull()).alias("suspicious"))


def purge_digest(plan: DataFrame) -> DataFrame:
    """Per kind of match the rows to delete, the suspicious ones and a digest of the ids in ascending order. Each id and
    a newline are hashed in runs of 65,536 ids, the runs' digests likewise, in four levels: no group is larger than that."""
    rows = plan.filter("action = 'would_delete'")
    level = rows.select("match", F.col("id").alias("k"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("d"), F.lit(1).cast("long").alias("rows"), F.col("suspicious").cast("long").alias("suspicious"))
    for _ in range(4):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "")
        level = level.groupBy("match", F.shiftright("k", 16).alias("up")).agg(F.sha2(joined.cast("binary"), 256).alias("d"), F.sum("rows").alias("rows"), F.sum("suspicious").alias("suspicious")).withColumnRenamed("up", "k")
    return level.select("match", "rows", "suspicious", F.col("d").alias("sha256"))


def purged(tm: DataFrame, plan: DataFrame, path: str) -> DataFrame:
    """The memory without the rows that the plan deletes, after a backup under path."""
    return backup(tm, path).join(plan.filter("action = 'would_delete'").select("id"), "id", "left_anti")


def stats(tm: DataFrame) -> DataFrame:
    """Entries and hits per stage, and in total (stage null)."""
    return tm.rollup("stage").agg(F.count(F.lit(1)).alias("entries"), F.sum("hit_count").alias("hits"))


def window_summary(tm: DataFrame, now, days: tuple[int, ...] = (7, 30, 36500), top: int = 5) -> DataFrame:
    """Per window: its most frequent sources by rank, the rest as one row."""
    rows = tm.select("source_name", "created_at", F.explode(F.array(*map(F.lit, days))).alias("days"))
    rows = rows.filter(F.col("created_at") >= F.timestamp_add("DAY", -F.col("days"), now))
    counts = rows.groupBy("days", "source_name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("days").orderBy(F.desc("n"), "source_name"))
    named = counts.withColumn("rank", F.least(rank, F.lit(top + 1))).withColumn("source", F.when(F.col("rank") <= top, F.col("source_name")).otherwise("other"))
    return named.groupBy("days", "rank", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """An order-free digest of a table's content: rows, sum and xor of 60-bit row hashes (the sum of their low 31 bits)."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"), F.bit_xor(h).alias("xor"))


def clear(tm: DataFrame, stage: int | None = None) -> DataFrame:
    return tm.limit(0) if stage is None else tm.filter(F.col("stage") != stage)
