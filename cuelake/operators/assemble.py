"""From requests to final rows: batches, numbered replies, assembly of stages, sampling for a synopsis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans.islands import by_file, island


def batches(cues: DataFrame, most: int = 20, gap_ms: int = 60_000) -> DataFrame:
    """scene and batch numbers: a scene ends where starts are more than gap_ms apart; its rows are cut into batches."""
    w = by_file()
    before = F.last("start_ms", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = cues.withColumn("scene", island(F.coalesce(F.col("start_ms") - before > gap_ms, F.lit(False)), w))
    place = F.row_number().over(Window.partitionBy("file_id", "scene").orderBy("pos")) - 1
    return rows.withColumn("batch", F.floor(place / most).cast("int"))


def parse_numbered(responses: DataFrame) -> DataFrame:
    """responses (file_id, batch_id, body, expected array<int>) to rows (file_id, batch_id, idx, text). '#N' lines whose
    number is expected open a block; its text stands after 'Translation>', or is all of it where that mark is missing.
    Of blocks with one number the last counts."""
    lines = responses.select("file_id", "batch_id", "expected", F.posexplode(F.split("body", r"\r?\n")).alias("no", "line"))
    number = F.regexp_extract("line", r"^\s*#(\d+)\s*$", 1)
    lines = lines.withColumn("n", F.when(number != "", number.cast("int")))
    lines = lines.withColumn("n", F.when(F.array_contains("expected", F.col("n")), F.col("n")))
    w = Window.partitionBy("file_id", "batch_id").orderBy("no")
    lines = lines.withColumn("block", F.sum(F.col("n").isNotNull().cast("int")).over(w))
    part = Window.partitionBy("file_id", "batch_id", "block")
    lines = lines.filter("block > 0").withColumns({"idx": F.max("n").over(part), "mark": F.min(F.when(F.col("line").rlike(r"^\s*Translation>"), F.col("no"))).over(part)})
    inline = F.regexp_replace("line", r"^\s*Translation>[ \t]*", "")
    body = F.when(F.col("n").isNotNull(), F.lit(None)).when(F.col("mark").isNull(), F.when(T.strip(F.col("line")) != "", F.col("line"))).when(F.col("no") == F.col("mark"), F.when(inline != "", inline)).when(F.col("no") > F.col("mark"), F.col("line"))
    blocks = lines.withColumn("part", body).groupBy("file_id", "batch_id", "block", "idx").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("no", "part")))).alias("p"), F.max(F.col("mark").isNotNull()).alias("marked"))
    text = T.strip(F.array_join(F.transform("p", lambda x: x["part"]), "\n"))
    rows = blocks.withColumn("text", text).filter("marked or text <> ''")
    return rows.groupBy("file_id", "batch_id", "idx").agg(F.max_by("text", "block").alias("text"))


def missing(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """Expected rows (file_id, idx) without a usable reply."""
    return expected.join(parsed.filter(T.strip(F.coalesce("text", F.lit(""))) != ""), ["file_id", "idx"], "left_anti")


def assemble(cues: DataFrame, memory: DataFrame, replies: DataFrame) -> DataFrame:
    """First stage: the memory's text, else the reply, else the marked source; origin says which."""
    rows = cues.join(memory.select("file_id", "idx", F.col("target_text").alias("m")), ["file_id", "idx"], "left").join(replies.select("file_id", "idx", F.col("text").alias("r")), ["file_id", "idx"], "left")
    reply = F.when(T.strip(F.col("r")) != "", F.col("r"))
    out = F.coalesce("m", reply, F.concat(F.lit(T.UNTRANSLATED + " "), "text"))
    origin = F.when(F.col("m").isNotNull(), "memory").when(reply.isNotNull(), "reply").otherwise("source")
    return rows.withColumns({"out": out, "origin": origin}).drop("m", "r")


def review_assemble(staged: DataFrame, replies: DataFrame, keep: Column) -> DataFrame:
    """Second stage: the reviewer's text unless empty; rows to keep stay; else the first stage's text."""
    rows = staged.join(replies.select("file_id", "idx", F.col("text").alias("r")), ["file_id", "idx"], "left")
    reply = T.keep_last_part(F.col("r"))
    final = F.when(keep, F.col("out")).when(T.strip(reply) != "", reply).otherwise(F.col("out"))
    return rows.withColumn("final", final).drop("r")


def synopsis_sample(cues: DataFrame, most: int = 6000, per_bucket: int = 750, least_buckets: int = 3, most_buckets: int = 8) -> DataFrame:
    """Rows for a synopsis: all of a short file, else the first rows of equal runs of the file within each run's budget."""
    whole, w = Window.partitionBy("file_id"), by_file("start_ms", "pos")
    rows = cues.filter(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("chars", F.length(T.strip(F.col("text"))))
    rows = rows.withColumns({"total": F.sum("chars").over(whole), "n": F.count(F.lit(1)).over(whole), "i": F.row_number().over(w) - 1})
    rows = rows.withColumn("buckets", F.when(F.col("total") <= most, 1).otherwise(F.greatest(F.lit(least_buckets), F.least(F.lit(most_buckets), F.ceil(F.col("total") / per_bucket)))))
    # Bucket k holds rows from k*n div b up to (k+1)*n div b.
    rows = rows.withColumn("bucket", F.floor(((F.col("i") + 1) * F.col("buckets") - 1) / F.col("n")).cast("int"))
    spent = F.sum(F.col("chars") + 1).over(Window.partitionBy("file_id", "bucket").orderBy("start_ms", "pos"))
    return rows.withColumn("spent", spent).filter((F.col("buckets") == 1) | (F.col("spent") <= most / F.col("buckets")))
