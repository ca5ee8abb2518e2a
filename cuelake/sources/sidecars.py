"""Side files: glossaries, memory exports, run manifests, scene telemetry, logs, review tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans.containment import containing_in
from cuelake.sources.reports import CSV

TM_COLUMNS = "source_text string, target_text string, stage int, hit_count long, source_lang string, target_lang string"
SCENE = "scene int, audio_duration_s double, produced_output boolean, fallback_segments double, max_temperature double, max_compression_ratio double, max_no_speech_prob double, mean_avg_logprob double"


def read_glossary(spark: SparkSession, path: str, encoding: str = "UTF-8", strict: bool = False) -> DataFrame:
    """Two or three columns, the third with aliases parted by '|'. Equal rows count once, in order."""
    rows = spark.read.schema("src string, dst string, alias string").option("encoding", encoding).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    return glossary_rows(rows.withColumn("ord", F.monotonically_increasing_id()))


def glossary_rows(rows: DataFrame) -> DataFrame:
    """rows (src, dst, alias, ord) as glossary rows."""
    aliases = F.filter(F.transform(F.split(F.coalesce("alias", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    clean = rows.select(F.trim(F.regexp_replace("src", "^﻿", "")).alias("src"), F.trim("dst").alias("dst"), aliases.alias("aliases"), "ord").filter("src <> '' and dst <> ''")
    return clean.groupBy("src", "dst", "aliases").agg(F.min("ord").alias("ord"))


def write_glossary(rows: DataFrame, path: str) -> None:
    rows.select("src", "dst", F.array_join("aliases", "|").alias("alias")).write.csv(path)


def learned_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing and new terms, the first of each folded (src, dst) kept."""
    both = existing.select("src", "dst", F.lit(0).alias("part"), "ord").unionByName(new.select("src", "dst", F.lit(1).alias("part"), "ord"))
    w = Window.partitionBy(F.lower("src"), F.col("dst")).orderBy("part", "ord")
    return both.withColumn("k", F.row_number().over(w)).filter("k = 1").select("src", "dst", "part", "ord")


def export_memory(tm: DataFrame, path: str, stage: int | None = None) -> None:
    rows = tm if stage is None else tm.filter(F.col("stage") == stage)
    rows.select("source_text", "target_text", "stage", "hit_count", "source_lang", "target_lang").orderBy("stage", F.desc("hit_count")).write.options(**CSV).csv(path)


def _memory_rows(spark: SparkSession, path: str) -> DataFrame:
    names = ["source", "target", "stage", "hits", "source_lang", "target_lang", "more"]
    return spark.read.schema(", ".join(f"{n} string" for n in names)).options(**CSV | {"header": False}).csv(path)


def rejected_memory(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export that have more columns than any layout, such as texts whose quotes were escaped otherwise."""
    return _memory_rows(spark, path).filter("more is not null")


def import_memory(spark: SparkSession, path: str, source_lang: str, target_lang: str) -> DataFrame:
    """Rows of an export for the upsert, of any of its layouts: two columns, three with the stage, or six with hits and
    languages. Heads are rows whose first column names it; stages that are no number are 0; missing languages are given;
    rows with more columns are left to rejected_memory()."""
    rows = _memory_rows(spark, path).filter("more is null")
    text = lambda c: T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), "^\ufeff", ""))
    rows = rows.select(text("source").alias("source_text"), text("target").alias("target_text"), *(text(c).alias(c) for c in ("stage", "source_lang", "target_lang")))
    rows = rows.filter((F.col("source_text") != "") & (F.col("target_text") != "") & ~F.lower("source_text").isin("source", "source_text", "原文", "original"))
    lang = lambda c, default: F.when(F.col(c) != "", F.col(c)).otherwise(F.lit(default)).alias(c)
    return rows.select(T.content_hash(F.col("source_text")).alias("content_hash"), "source_text", "target_text", F.when(F.col("stage").rlike(r"^\d+$"), F.col("stage").try_cast("int")).otherwise(0).alias("stage"), lang("source_lang", source_lang), lang("target_lang", target_lang))


def run_meta(lines: DataFrame, status: tuple[str, ...] = ("status", "state", "result"), coverage: tuple[str, ...] = ("mileage_pct", "coverage", "coverage_ratio")) -> DataFrame:
    """file_id, value (JSON) to status and coverage in per cent; values up to 1 are shares."""
    get = lambda names: F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in names))
    number = get(coverage).try_cast("double")
    return lines.select("file_id", get(status).alias("status"), F.bround(F.when(number <= 1, number * 100).otherwise(number), 4).alias("coverage_pct"))


def scene_telemetry(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file_id, line_no, value (JSON line) to scenes, the first row of each, and the count of bad lines per file."""
    rows = lines.withColumn("s", F.from_json("value", SCENE))
    ok = F.col("s.scene").isNotNull() & (F.col("s.scene") >= 0)
    first = F.row_number().over(Window.partitionBy("file_id", "s.scene").orderBy("line_no"))
    good = rows.filter(ok).withColumn("k", first).filter("k = 1").select("file_id", "s.*")
    return good, rows.filter(~ok & (F.trim("value") != "")).groupBy("file_id").agg(F.count(F.lit(1)).alias("bad_lines"))


def fresh(files: DataFrame, sidecars: DataFrame, hours: float) -> DataFrame:
    """Sidecars (key, modified) not older than their file by more than some hours."""
    rows = sidecars.join(files.select("key", F.col("modified").alias("file_modified")), "key")
    return rows.filter(F.unix_timestamp("file_modified") - F.unix_timestamp("modified") <= hours * 3600)


def discover(files: DataFrame, sidecars: DataFrame, ending: str, endings: tuple[str, ...]) -> DataFrame:
    """Files (name) with the one sidecar (name, ends with ending) that begins with their stem, off which all endings
    (a project's marks of language and pipeline) are taken, one after the other; none where there are several. They meet by the stem's first characters."""
    tail = "|".join(re.escape(e) for e in endings)
    files = files.withColumn("stem", F.regexp_extract(F.regexp_replace("name", r"\.[^.]+$", ""), f"(?i)^(.+?)(?:{tail})*$", 1))
    rest = F.col("name").substr(F.lit(1), F.length("name") - len(ending))
    right = sidecars.filter(F.endswith(F.lower("name"), F.lit(ending))).select(F.col("name").alias("sidecar"), rest.alias("rest"), F.explode(F.array_distinct(F.array(*(F.substring(rest, 1, k) for k in (1, 2, 3, 4))))).alias("head"))
    pairs = files.withColumn("head", F.substring("stem", 1, 4)).join(right, "head").filter(F.startswith("rest", F.col("stem")))
    return pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("sidecar").alias("sidecar")).filter("n = 1").select("name", "sidecar")


def pair_media(files: DataFrame, manifests: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Files (path) with media and source: override (path, media) where given, else the first entry of a manifest (manifest,
    files array<struct<path,output>>) whose output is the file; both paths are compared without case, and with '/'."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/\\.?/", "/"))
    entries = manifests.select("manifest", F.posexplode("files").alias("at", "f")).filter("f.output <> ''")
    first = entries.groupBy(plain(F.col("f.output")).alias("key")).agg(F.min_by(T.strip(F.col("f.path")), F.struct("manifest", "at")).alias("hit"))
    rows = files.withColumn("key", plain(F.col("path"))).join(first, "key", "left").drop("key")
    if overrides is not None:
        rows = rows.join(overrides.select("path", F.col("media").alias("given")), "path", "left")
    given = F.when(F.col("given") != "", F.col("given")) if overrides is not None else F.lit(None).cast("string")
    hit = F.when(F.col("hit") != "", F.col("hit"))
    return rows.withColumns({"media": F.coalesce(given, hit, F.lit("")), "source": F.when(given.isNotNull(), "override").when(hit.isNotNull(), "manifest").otherwise("")}).drop("hit", "given")


def resume_states(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Input files (folder, name) with state: completed when their final file is in the listing (folder, name, content),
    resumable when only their manifest is, else none. A manifest's direction a→b names the final file's language."""
    stem = T.strip_language_suffix(F.regexp_replace("name", r"\.[^.]+$", ""))
    rows = files.withColumn("stem", stem)
    found = listing.filter(F.endswith("name", F.lit("_manifest.json"))).select("folder", F.regexp_replace("name", r"_manifest\.json$", "").alias("stem"), F.split(F.coalesce(F.get_json_object("content", "$.direction"), F.lit("ja→zh")), "→").alias("d"))
    target = F.when(F.size("d") > 1, F.element_at("d", -1)).otherwise("zh")
    rows = rows.join(found.select("folder", "stem", target.alias("target"), F.lit(True).alias("manifest")).dropDuplicates(["folder", "stem"]), ["folder", "stem"], "left")
    ending = F.when(F.coalesce("target", F.lit("zh")) == "zh", "cn").otherwise(F.col("target"))
    finals = listing.select("folder", F.col("name").alias("final"), F.lit(True).alias("done")).distinct()
    rows = rows.withColumn("final", F.concat("stem", F.lit("_final_"), ending, F.lit(".srt"))).join(finals, ["folder", "final"], "left")
    return rows.select("folder", "name", "stem", F.when(F.col("done"), "completed").when(F.col("manifest"), "resumable").otherwise("none").alias("state"))


def lanes(files: DataFrame) -> DataFrame:
    """Names like base.pass1.srt by base: the lanes that exist and mode dual, missing or none."""
    base, lane = F.regexp_extract("name", r"^(.*)\.(pass1|pass2|merged)\.[^.]+$", 1), F.regexp_extract("name", r"^(.*)\.(pass1|pass2|merged)\.[^.]+$", 2)
    rows = files.select(base.alias("base"), lane.alias("lane"), "name").filter("lane <> ''").groupBy("base").pivot("lane", ["pass1", "pass2", "merged"]).agg(F.min("name"))
    mode = F.when(F.col("pass1").isNotNull() & F.col("pass2").isNotNull(), "dual").when(F.col("pass1").isNotNull() | F.col("pass2").isNotNull(), "missing").otherwise("none")
    return rows.withColumn("mode", mode)


#: Heads of a context file's two parts (fixed format).
SUMMARY_HEAD, MISHEAR_HEAD = "【剧情摘要】", "【误听怀疑】"


def context_sidecar(lines: DataFrame) -> DataFrame:
    """file_id, line_no, value to summary rows, and mishear rows of 'a => b' lines with suspect and correct. A summary may
    begin beside its head; lines before a head, lines that begin with # and pairs with an empty side are dropped."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    s = T.strip(F.coalesce("value", F.lit("")))
    head = F.when(F.startswith(s, F.lit(SUMMARY_HEAD)), "summary").when(F.startswith(s, F.lit(MISHEAR_HEAD)), "mishear")
    rows = lines.withColumns({"head": head, "s": s}).withColumn("kind", F.last("head", True).over(w))
    value = F.when(F.col("head") == "summary", T.strip(F.substring("s", len(SUMMARY_HEAD) + 1, 1 << 30))).when(F.col("head").isNull(), F.col("s"))
    rows = rows.withColumn("value", value).filter("kind is not null and value <> ''").filter(F.col("head").isNotNull() | ~F.startswith("s", F.lit("#")))
    side = lambda k: F.when(F.col("kind") == "mishear", T.strip(F.regexp_extract("value", "^(.*?)=>(.*)$", k))).otherwise("")
    rows = rows.select("file_id", "line_no", "kind", "value", side(1).alias("suspect"), side(2).alias("correct"))
    return rows.filter("kind = 'summary' or (suspect <> '' and correct <> '')")


def mishear_rows(final: DataFrame, pairs: DataFrame) -> DataFrame:
    """Final rows (aligned: orig_text) that hold a suspect word of their file's context, one row per pair."""
    texts = final.select("file_id", "pos", "idx", "text", T.strip(F.coalesce("orig_text", F.lit(""))).alias("s"))
    rows = containing_in(texts, pairs.filter("suspect <> ''").select("file_id", "suspect", "correct"), "file_id", lambda x: F.contains("s", x["suspect"]))
    return rows.select("file_id", "pos", "idx", "suspect", "correct", F.substring(T.strip(F.coalesce("text", F.lit(""))), 1, 60).alias("preview"))


def log_batches(lines: DataFrame) -> DataFrame:
    """file_id, line_no, value of run logs 'HH:MM:SS message': run number, batch, seconds. Clocks that fall by half a day
    have passed midnight; a run begins at its header."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    part = lambda k: F.regexp_extract("value", r"^(\d{2}):(\d{2}):(\d{2})\b", k)
    rows = lines.filter(part(1) != "").withColumn("clock", (part(1).cast("int") * 60 + part(2).cast("int")) * 60 + part(3).cast("int"))
    rows = rows.withColumn("day", F.sum(F.when(F.col("clock") < F.lag("clock").over(w) - 43_200, 1).otherwise(0)).over(w))
    rows = rows.withColumns({"at": F.col("day") * 86_400 + F.col("clock"), "run": F.sum(F.when(F.col("value").rlike("(?i)run start"), 1).otherwise(0)).over(w)})
    batch = F.regexp_extract("value", r"(?i)batch (\d+)", 1)
    rows = rows.filter(batch != "").withColumn("batch", batch.cast("int"))
    before = F.lag("at").over(Window.partitionBy("file_id", "run").orderBy("line_no"))
    return rows.select("file_id", "run", "batch", "at", (F.col("at") - before).alias("seconds"))


def batch_summary(batches: DataFrame) -> DataFrame:
    """Per file: runs and batches, the least, upper median, mean and total seconds of a batch, the seconds from its first
    batch to its last, and batches an hour. Batches without a batch before them have no duration."""
    seconds = F.sort_array(F.collect_list("seconds"))  # the batches of one log
    out = batches.groupBy("file_id").agg(F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("batches"), F.min("seconds").alias("least"), F.get(seconds, F.floor(F.count("seconds") / 2).cast("int")).alias("median"), F.round(F.avg("seconds"), 6).alias("mean"), F.sum("seconds").alias("total"), (F.max("at") - F.min("at")).alias("span_s"))
    return out.withColumn("per_hour", F.when(F.col("span_s") > 0, F.round(3600 * F.col("batches") / F.col("span_s"), 6)))


def append_dropped(rows: DataFrame, path: str, stage: str, reason) -> None:
    """Dropped rows to the archive, a folder per day."""
    rows.select("file_id", F.lit(stage).alias("stage"), "idx", reason.alias("reason"), "text", F.current_date().alias("day")).write.mode("append").partitionBy("day").parquet(path)
