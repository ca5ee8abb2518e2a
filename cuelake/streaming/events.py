"""Run events as a stream: parsing, de-duplication, progress, stalls, daily counters, and learning into the memory.

Event time is the event's own clock; rows more than the watermark late are dropped by the stateful operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVENT = "protocol_version int, task_id string, seq long, timestamp timestamp, type string, phase string, file string, payload map<string,string>"
TYPES = ("run_started", "run_finished", "phase_started", "phase_progress", "phase_finished", "file_finished", "risk", "error", "heartbeat", "log")
LATE = "10 minutes"


def parse_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """value strings to events, and the lines that aren't events: no JSON, no version, no task or an unknown type.
    Old progress lines 'Stage A: 3/10' become phase_progress events."""
    rows = lines.withColumn("e", F.from_json("value", EVENT))
    stage, done, of = (F.regexp_extract("value", r"^\s*Stage\s+(\w+):\s*(\d+)/(\d+)", k) for k in (1, 2, 3))
    old = F.when(stage != "", F.struct(F.lit(0).alias("protocol_version"), F.lit("legacy").alias("task_id"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit("phase_progress").alias("type"), stage.alias("phase"), F.lit(None).cast("string").alias("file"), F.create_map(F.lit("done"), done, F.lit("total"), of).alias("payload")))
    ok = F.col("e.protocol_version").isNotNull() & F.col("e.task_id").isNotNull() & F.col("e.type").isin(*TYPES)
    rows = rows.withColumn("e", F.when(ok, F.col("e")).otherwise(old))
    return rows.filter("e is not null").select("e.*"), rows.filter("e is null").select("value")


def distinct_risks(events: DataFrame, late: str = LATE) -> DataFrame:
    """The first error of a task with its type, phase, file and message within the watermark."""
    key = ["task_id", "type", "phase", "file", "message"]
    rows = events.filter("type = 'error'")
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else rows.dropDuplicates(key)


def watch_totals(records: DataFrame, size: str = "1 day", late: str = LATE) -> DataFrame:
    """Candidates and conflicts per window and term from a stream of watch records (ts, per_term map)."""
    rows = records.withWatermark("ts", late) if records.isStreaming else records
    rows = rows.select("ts", F.explode("per_term").alias("term", "v"))
    out = rows.groupBy(F.window("ts", size).alias("w"), "term").agg(F.sum("v.candidates").alias("candidates"), F.sum("v.conflicts").alias("conflicts"))
    return out.select(F.col("w.start").alias("window_start"), "term", "candidates", "conflicts")


def stalls(events: DataFrame, gap: str = "45 seconds", late: str = LATE) -> DataFrame:
    """Sessions of a task without a pause of gap: when each ended is when the task stalled."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("task_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return out.select("task_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = LATE) -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "type", "n", "value")


def progress(events: DataFrame) -> DataFrame:
    """Current state per task: the newest event by seq, however late it came, and counters. In a stream (update
    or complete mode) the state is one row per task."""
    newest = F.max(F.struct("seq", "type", "phase", "k"))
    out = events.groupBy("task_id").agg(newest.alias("m"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("type") == "error").alias("errors"))
    return out.select("task_id", F.col("m.seq").alias("seq"), F.col("m.type").alias("type"), F.col("m.phase").alias("phase"), F.col("m.k").alias("k"), "events", "errors")


def file_states(events: DataFrame, finished: str = "file_finished") -> DataFrame:
    """done or running for every file of a task; a finished file stays done."""
    out = events.filter("file is not null and file <> ''").groupBy("task_id", "file").agg(F.max(F.col("type") == finished).alias("done"), F.max("seq").alias("seq"))
    return out.select("task_id", "file", F.when(F.col("done"), "done").otherwise("running").alias("state"), "seq")


def learn_stream(pairs: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of pairs goes through merge(batch, id), which writes the memory's next version; ids make it idempotent."""
    return pairs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.srt") -> DataFrame:
    """New files as rows (path, content), for the cue parser. Tasks list the folder, a share each; what was read is kept as a
    time, so nothing on the driver grows with the files' number. A file that can't be read fails the batch."""
    from cuelake.sources.cue_source import cue_files, shares_of

    rows = cue_files(spark, folder, stream=True, pattern=pattern, shares=shares_of(spark))
    return rows.select("path", F.when(F.col("error").isNull(), F.col("content").cast("string")).otherwise(F.raise_error("error")).alias("content"))


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table under folder, and read the table."""
    spark, path = stream.sparkSession, f"{folder}/table"
    if mode == "append":
        stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
