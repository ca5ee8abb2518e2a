"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is contained in a document exactly when its shingles (runs of up to four words) lie at
consecutive places. One pass over the texts keeps, per document, the runs of words whose shingles all occur in
the benchmark by a filter of bits; nearly everything ends there. Long runs are cut into chunks that overlap by a
window less a word, so that every window lies whole in one of them. The rest is DataFrame work: count the shingles'
rarity, take each window's rarest shingle as its prefix (a containment of one needs no longer prefix), join it,
apply the positional and length bounds, fetch the chunk's words for what is left, and verify the window word by word.
Shingles travel without words, so the work grows with a run's length, not with its square.

Edge cases: null or word-less documents have no words and aren't contaminated; items without words are dropped;
an item shorter than the window is one window; items with equal windows all count; equal documents share their
evidence; rows are judged by their own text, also where ids are null or shared; empty tables give no hits; other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import ALNUM_WORD_BYTES, as_bytes, bit_filter, durable, in_filter, shingle_hashes, small, word_hashes

WINDOW = 13
SHINGLE = 4
#: Words of a chunk of a run.
CHUNK = 64

_RUN = pa.struct([("start", pa.int64()), ("words", pa.list_(pa.int64()))])


def words_of(raw: bytes | None) -> np.ndarray:
    return word_hashes(raw.lower(), ALNUM_WORD_BYTES) if raw else np.empty(0, np.uint64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(raw).view(np.int64) for raw in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["item", "words"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows' shingles: window and its words stay beside place and shingle."""
    for batch in batches:
        rows = []
        for words in batch.column(0).to_pylist():
            w = np.array(words, np.int64).view(np.uint64)
            rows += [(words, k, int(s)) for k, s in enumerate(shingle_hashes(w, min(SHINGLE, w.size)).view(np.int64))]
        words, places, shingles = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array(places, pa.int32()), pa.array(shingles, pa.int64())], ["words", "place", "shingle"])


def windows(benchmark: DataFrame) -> DataFrame:
    """item, words (a window as word hashes): one row per window of an item, repeats once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(_item_words, "item string, words array<long>")
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    return items.filter(n > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, WINDOW))).alias("words")).distinct()


def _scanner(bits: np.ndarray, widths: list[tuple[int, int]]):
    """widths: pairs of a shingle's width and the shortest window, in words, that is made of such shingles."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, found = [], [], []
            for raw in as_bytes(batch.column(1)):
                words = words_of(raw)
                runs = []
                for width, shortest in widths:
                    if words.size < shortest:
                        continue
                    hit = in_filter(bits, shingle_hashes(words, width).view(np.int64))
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        run = words[a : b + width - 1]
                        if run.size >= shortest:
                            runs += [{"start": int(a) + k, "words": run[k : k + CHUNK].view(np.int64)} for k in range(0, max(run.size - WINDOW + 1, 1), CHUNK - WINDOW + 1)]
                sizes.append(words.size)
                keys.append(hashlib.blake2b(b"".join(r["start"].to_bytes(8) + r["words"].tobytes() + b"|" for r in runs), digest_size=16).digest() if runs else None)
                found.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(_RUN)), batch.column(2)], ["doc_id", "n_words", "key", "runs", "_text"])

    return scan


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with _text, the digest of the row's text."""
    spans = durable(windows(benchmark))
    distinct = durable(spans.select("words").distinct())
    shingles = durable(distinct.mapInArrow(_shingle_rows, "words array<long>, place int, shingle long"))
    bits = bit_filter(shingles, "shingle")
    lengths = sorted(r[0] for r in distinct.select(F.size("words")).distinct().collect())  # at most WINDOW rows
    widths = sorted({(min(SHINGLE, n), min(m for m in lengths if min(SHINGLE, m) == min(SHINGLE, n))) for n in lengths})

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("_text"))
    kind = "doc_id long, n_words long, key binary, runs array<struct<start: long, words: array<long>>>, _text string"
    rows = durable(texts.mapInArrow(_scanner(bits, widths), kind))
    evidence = rows.filter("key is not null").dropDuplicates(["key"]).select("key", F.explode("runs").alias("run"))
    evidence = durable(evidence.select("key", "run.start", "run.words").distinct())  # runs of several widths may share a chunk

    places = durable(evidence.mapInArrow(_run_shingles(sorted({w for w, _ in widths})), "key binary, start long, size int, place int, shingle long"))
    rarity = places.groupBy("shingle").agg(F.countDistinct("key").alias("df"))
    by_rarity = Window.partitionBy("words").orderBy(F.coalesce("df", F.lit(0)), "shingle", "place")
    prefix = shingles.join(rarity, "shingle", "left").withColumn("_k", F.row_number().over(by_rarity)).filter("_k = 1")
    prefix = durable(prefix.select("shingle", F.col("place").alias("offset"), F.col("words").alias("window")))
    first = F.col("place") - F.col("offset")
    joined = places.join(small(prefix), "shingle").filter((first >= 0) & (first + F.size("window") <= F.col("size"))).select("key", "start", "size", first.alias("first"), "window")
    chunks = evidence.withColumn("size", F.size("words"))  # a start may have a chunk per width
    verified = joined.join(chunks, ["key", "start", "size"]).filter(F.slice("words", F.col("first") + 1, F.size("window")) == F.col("window"))
    hits = durable(verified.select("key", (F.col("start") + F.col("first")).alias("at"), "window").distinct())

    order = Window.partitionBy("key").orderBy("at", "end")
    covered = hits.groupBy("key", "at").agg((F.col("at") + F.max(F.size("window"))).alias("end"))
    seen = F.greatest("at", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    covered = covered.withColumn("fresh", F.greatest(F.col("end") - seen, F.lit(0))).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    items = hits.select("key", "window").distinct().join(small(spans.withColumnRenamed("words", "window")), "window").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))  # at most the benchmark's items
    found = durable(covered.join(items, "key"))
    out = rows.select("doc_id", "n_words", "key", "_text").join(small(found), "key", "left")
    none: list = []
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array(*none).cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "_text")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    return _judged(docs, benchmark).drop("_text")


def _run_shingles(widths: list[int], step: int = 512):
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = [np.array(words, np.int64).view(np.uint64) for words in batch.column(2).to_pylist()]
                found = [(i, shingle_hashes(w, width).view(np.int64)) for i, w in enumerate(lists) for width in widths]
                take = np.repeat(np.array([i for i, _ in found], np.int64), np.array([s.size for _, s in found], np.int64))
                size = np.array([w.size for w in lists], np.int32)[take]
                places = np.concatenate([np.arange(s.size, dtype=np.int32) for _, s in found])
                columns = [batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)), pa.array(size), pa.array(places), pa.array(np.concatenate([s for _, s in found]))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "size", "place", "shingle"])

    return shingles


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input without its contaminated documents, each judged by its text."""
    bad = durable(_judged(docs, benchmark).filter("contaminated").select(F.col("_text").alias("_bad")).distinct())
    return docs.join(small(bad), F.md5(docs["text"].cast("string").cast("binary")) == F.col("_bad"), "left_anti")
