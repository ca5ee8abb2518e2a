"""Review tables, logs and reports that later runs or people read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cuelake.functions import text as T
from cuelake.functions.timecode import timing
from cuelake.operators.passes import best_overlap
from cuelake.operators.quality import majority_events

#: How tables are written: with a head, quotes doubled, white space kept.
CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Files that may lie beside a file's guide (fixed names, the file's stem in front).
COMPANIONS = ("_final_cn.srt", "_质量报告.txt", "_分歧复核.csv", "_风险清单.md", "_风险清单.json", "_术语冲突观察.csv")
REVIEW = "file_id string, group string, timing string, similarity string, iou string, offset_s string, artifact string, text1 string, text2 string, final_text string"


def divergence_review(rows: DataFrame, final: DataFrame, optional: int = 100) -> DataFrame:
    """What a person should compare: all must-see rows, a file's first optional rows by similarity, all artifacts, each with
    the final row that overlaps it most. rows come from review_groups() and have the merged row's span."""
    place = F.row_number().over(Window.partitionBy("file_id", "group").orderBy("similarity", "pos"))
    picked = rows.withColumn("place", place).filter(F.col("group").isin("must_see", "artifact") | ((F.col("group") == "optional") & (F.col("place") <= optional)))
    found = best_overlap(picked, final).withColumn("final_text", F.coalesce("r_text", F.lit("")))
    return found.select(*picked.columns, "final_text")


def write_review(rows: DataFrame, path: str, *order: str) -> None:
    """A review table as CSV with a head, its rows in order."""
    rows = rows.repartition("file_id", "group")  # the sort reads its rows twice; dealt out they are made once
    out = rows.select("file_id", "group", timing(F.col("start_ms"), F.col("end_ms")).alias("timing"), *(F.format_number(c, n).alias(c) for c, n in (("similarity", 4), ("iou", 4), ("offset_s", 3))), "artifact", "text1", "text2", "final_text")
    out.orderBy(*(order or ("file_id", "group", "similarity", "timing"))).write.options(**CSV).csv(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """The rows of review tables, all as text."""
    return spark.read.schema(REVIEW).options(**CSV).csv(path)


def write_enhanced(rows: DataFrame, path: str, version: str, clip: int = 200) -> None:
    """Reviewed rows (film, film_rank, place, the review's columns and its verdict) as CSV in review order: the evidence is
    'pass@time' of a category 1 verdict that has both, reasons are clipped, the version of the prompt is on every row."""
    evidence = F.when((F.col("category") == 1) & (F.col("evidence_pass") != "") & (F.col("evidence_timing") != ""), F.concat_ws("@", "evidence_pass", "evidence_timing")).otherwise("")
    out = rows.orderBy("film_rank", "place").select("film", "pos", "group", "similarity", "category", F.coalesce("side", F.lit("")).alias("side"), evidence.alias("evidence"), "verify", "confidence", F.substring("reason", 1, clip).alias("reason"), F.lit(version).alias("version"))
    out.write.options(**CSV).csv(path)


def write_conflicts(conflicts: DataFrame, path: str) -> None:
    """Term conflicts (entry_id, timing, source_term, expected_targets: the translation and its aliases with bars between them,
    actual_text) with the time of writing; of the text the first 60 characters show."""
    conflicts.select("entry_id", "timing", "source_term", "expected_targets", F.substring(T.strip(F.col("actual_text")), 1, 60).alias("actual_text"), F.current_timestamp().alias("created_at")).write.options(**CSV).csv(path)


def companions(stems: DataFrame, listing: DataFrame) -> DataFrame:
    """For each stem the map of its companion files to whether they are in the listing (name)."""
    rows = stems.select("stem", F.explode(F.array(*map(F.lit, COMPANIONS))).alias("ending")).withColumn("name", F.concat("stem", "ending"))
    rows = rows.join(listing.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    return rows.groupBy("stem").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.coalesce("there", F.lit(False)).alias("v"))))).alias("companions"))


def write_guide(items: DataFrame, stems: DataFrame, listing: DataFrame, path: str) -> None:
    """A JSON line per file (stems: file_id, stem) with its guide items in order and its companions, gzipped. A file's guide is
    bounded. Stems meet their companions first, so the items aren't dealt by stem again."""
    lists = items.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("place", "idx", "timing", "category", "message", "current_text", "source_excerpt", "status"))).alias("items"))
    beside = stems.join(companions(stems, listing), "stem")
    lists.join(beside, "file_id").select("file_id", "stem", "items", "companions").write.json(path, compression="gzip")


def write_risks(events: DataFrame, files: DataFrame, path: str) -> None:
    """A JSON line per file with risks: its events, that most of it is untranslated among them, and whether it is; files
    without any aren't written."""
    columns = ["file_id", "stage", "reason", "action", "severity", "entry_range", "timing_range", "affected", "timings"]
    lists = events.select(*columns).unionByName(majority_events(files).select(*columns)).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("stage", "reason", "action", "severity", "entry_range", "timing_range", "affected", "timings"))).alias("events"))
    rows = files.select("file_id", "untranslated_majority").join(lists, "file_id", "left").filter("events is not null or untranslated_majority")
    rows.select("file_id", F.greatest(F.size("events"), F.lit(0)).alias("risk_count"), "untranslated_majority", "events").write.json(path)


def append_ledger(records: DataFrame, path: str) -> None:
    """Retranslations that were applied: file_id, idx, timing, old_text, new_text; rows are only ever added."""
    records.select("file_id", "idx", "timing", "old_text", "new_text", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def append_watch(records: DataFrame, path: str) -> None:
    """Watch records (date, source, per_term) with room for marks of false positives; rows are only ever added."""
    none = F.from_json(F.lit("{}"), "map<string,struct<count:bigint,category:string>>")
    records.select("date", "source", "per_term", F.col("manual_fp") if "manual_fp" in records.columns else none.alias("manual_fp")).write.mode("append").parquet(path)


def read_watch(spark: SparkSession, path: str) -> DataFrame:
    """The watch log; an empty one where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "date date, source string, per_term map<string,struct<candidates:bigint,conflicts:bigint>>, manual_fp map<string,struct<count:bigint,category:string>>")


def labelled_sample(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Lines 'idx|prefix|similarity|H:M:S|P1:text|P2:text' with the label of their idx (labels: idx, label), or an empty one.
    Where idx alone doesn't tell lines of several prefixes apart, labels have a prefix too. Lines of other shapes and numbers
    that aren't numbers are dropped."""
    part = F.split(T.strip(F.col("value")), r"\|", 6)
    rows = lines.select(part.alias("p")).filter(F.size("p") == 6)
    clock = F.split(F.split(F.col("p")[3], "[,.]")[0], ":")
    seconds = (F.try_element_at(clock, F.lit(1)).try_cast("long") * 60 + F.try_element_at(clock, F.lit(2)).try_cast("long")) * 60 + F.try_element_at(clock, F.lit(3)).try_cast("long")
    text = lambda k: F.regexp_replace(F.col("p")[3 + k], f"^P{k}:", "")
    rows = rows.select(F.col("p")[0].try_cast("long").alias("idx"), F.col("p")[1].alias("prefix"), F.col("p")[2].try_cast("double").alias("similarity"), seconds.alias("at_s"), text(1).alias("text1"), text(2).alias("text2"))
    key = [c for c in ("idx", "prefix") if c in labels.columns]
    known = labels.groupBy(*key).agg(F.max(T.strip(F.col("label"))).alias("label"))
    return rows.filter("idx is not null and similarity is not null").join(known, key, "left").withColumn("label", F.coalesce("label", F.lit("")))
