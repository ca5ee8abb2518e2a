"""Energy series: thresholds by rank, speech segments, speech inside the pauses between cues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.plans.islands import interval_join, island
from cuelake.operators.quality import gap_observations

#: Values of a series that go to Python as one row; a batch has up to 10,000 rows.
BLOCK = 512


def series_segments(series: DataFrame, pct: int = 85, hop_ms: int = 10) -> DataFrame:
    """Runs of neighbouring values above the file's threshold as spans, and the file's length (total_ms). series is a row per file:
    file_id, and rms in order without gaps. The threshold is that of threshold(). A file's values are never rows, and no
    exchange or sort sees them: they reach a task's Python in blocks, which follow each other, and a file is held at a time."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            ids, last = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            values, at = batch.column(2).flatten().to_numpy(), np.diff(batch.column(2).offsets.to_numpy()).cumsum()
            begin, out = 0, []
            for k in np.flatnonzero(last):
                held.append(values[begin : at[k]])
                begin = at[k]
                rms, held = np.concatenate(held), []
                rank = (rms.size - 1) * (pct / 100)
                loud = np.concatenate(([False], rms > np.partition(rms, int(np.round(rank)))[int(np.round(rank))], [False]))
                edges = np.flatnonzero(loud[1:] != loud[:-1]) * hop_ms
                out.append((k, edges[0::2], edges[1::2], rms.size * hop_ms))
            held.append(values[begin:].copy())
            spans = [np.concatenate([np.zeros(0, np.int64), *x]) for x in ([o[1] for o in out], [o[2] for o in out], [np.full(o[1].size, o[3]) for o in out])]
            whose = np.concatenate([np.zeros(0, np.int64), *(np.full(o[1].size, o[0]) for o in out)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), *map(pa.array, spans)], ["file_id", "start_ms", "end_ms", "total_ms"])

    last = F.floor((F.size("rms") - 1) / BLOCK).cast("int")
    blocks = series.select("file_id", "rms", F.explode(F.when(F.size("rms") > 0, F.sequence(F.lit(0), last))).alias("_k"))
    blocks = blocks.select("file_id", (F.col("_k") == last).alias("last"), F.slice("rms", F.col("_k") * BLOCK + 1, F.lit(BLOCK)).alias("rms"))
    return blocks.mapInArrow(runs, f"file_id {series.schema['file_id'].dataType.simpleString()}, start_ms long, end_ms long, total_ms long")


def series_ratio(segments: DataFrame) -> DataFrame:
    """Milliseconds and per cent of speech per file that has some, from series_segments()."""
    rows = segments.groupBy("file_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.max("total_ms").alias("ms"))
    return rows.select("file_id", "speech_ms", F.bround(100 * F.col("speech_ms") / F.col("ms"), 1).alias("speech_pct"))


def threshold(hops: DataFrame, pct: int = 85) -> DataFrame:
    """Per file the value whose 0-based rank is pct of the last rank, rounded half to even. Equal values are counted
    before they are ordered, so files aren't sorted hop by hop."""
    counts = hops.groupBy("file_id", "rms").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("file_id").orderBy("rms"))
    rows = counts.withColumns({"upto": upto, "last": F.sum("n").over(Window.partitionBy("file_id")) - 1})
    return rows.filter(F.col("upto") > F.bround(F.col("last") * (pct / 100))).groupBy("file_id").agg(F.min("rms").alias("threshold"))


def speech_segments(hops: DataFrame, limits: DataFrame, hop_ms: int = 10) -> DataFrame:
    """Runs of neighbouring hops above the file's threshold as spans."""
    w = Window.partitionBy("file_id").orderBy("hop_no")
    loud = hops.join(limits, "file_id").filter("rms > threshold").select("file_id", "hop_no")
    loud = loud.withColumn("run", island(F.coalesce(F.col("hop_no") != F.lag("hop_no").over(w) + 1, F.lit(True)), w))
    return loud.groupBy("file_id", "run").agg((F.min("hop_no") * hop_ms).alias("start_ms"), ((F.max("hop_no") + 1) * hop_ms).alias("end_ms"))


def speech_ratio(segments: DataFrame, hops: DataFrame, hop_ms: int = 10) -> DataFrame:
    total = hops.groupBy("file_id").agg((F.count(F.lit(1)) * hop_ms).alias("ms"))
    return segments.groupBy("file_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms")).join(total, "file_id").select("file_id", "speech_ms", F.bround(100 * F.col("speech_ms") / F.col("ms"), 1).alias("speech_pct"))


def speech_in_gaps(cues: DataFrame, segments: DataFrame, least_ms: int = 300, top: int = 20) -> DataFrame:
    """Pauses with speech energy in them, the first of each file: milliseconds of overlap."""
    gaps = gap_observations(cues, (least_ms - 1) / 1000).select("file_id", "idx", F.col("prev_end_ms").alias("start_ms"), F.col("start_ms").alias("end_ms"), "gap_ms")
    pairs = interval_join(gaps, segments, ["file_id"])
    rows = pairs.groupBy("file_id", "idx", "start_ms", "gap_ms").agg(F.sum("overlap_ms").alias("speech_ms"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy("start_ms", "idx"))).filter(F.col("rank") <= top)
