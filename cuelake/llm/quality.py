"""Quality classifier by Bradley-Terry ranking of preference pairs.

A document's features are shares of its bytes and words; its strength is linear in them. Pairs of a preferred and
a rejected labelled document teach the weights by logistic loss on feature differences. The cut is the quantile of
training strengths at the labels' rate, moved to where the fewest training documents are on the wrong side (training error
decides, no held-out label does); the score maps the cut to one half.

Every labelled row of the training fold teaches: rows go by hash to blocks of about BLOCK rows, each block learns weights on the
scale of all rows, and the weights' mean by pairs is the model's. The cut is over the strengths of all rows, counted in fine
steps. Scoring covers every text whole.

Edge cases: empty and null texts get the features of no words and a score like any text; without labels of both
kinds all documents score one half; repeated labels of a document count once; other columns of the inputs are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import SPACE_WORD_BYTES, as_bytes, bit_filter, durable, filter_fits, fold, in_filter, small, word_hashes

#: Labelled rows of a block. Labels, 16 bytes each, up to which they are broadcast. Steps that strengths are counted in.
BLOCK, LABELS, STEPS = 8_000, 1_000_000, 1 << 16
PAIRS = 20
#: Rows of a batch whose texts are taken out at a time.
SLICE = 256

_letters = np.zeros((6, 256))
_letters[0, ord("A") : ord("Z") + 1] = 1
_letters[1, ord("0") : ord("9") + 1] = 1
_letters[2, [ord(c) for c in "#*$%&|<>"]] = 1
_letters[3, [ord(c) for c in "!?"]] = 1
_letters[4, [ord(c) for c in ".,;:"]] = 1
_letters[5, [ord(c) for c in "|{}[]()_=/\\@"]] = 1
FEATURES = 16


def features(raw: bytes | None) -> np.ndarray:
    out = np.zeros(FEATURES)
    b = np.frombuffer(raw or b"", np.uint8)
    counts = np.bincount(b, minlength=256)
    words = word_hashes(raw, SPACE_WORD_BYTES) if b.size else np.empty(0, np.uint64)
    n = max(words.size, 1)
    out[:6] = np.sqrt(_letters @ counts / max(b.size, 1))
    space = counts[[0x20, 9, 10, 11, 12, 13]].sum()
    word, kinds = (b.size - space) / n, np.unique(words).size
    out[6] = min(words.size, 10) / 10
    out[7] = min(words.size, 100) / 100
    out[8] = abs(np.log(max(word, 0.5) / 6))
    out[9] = np.log(kinds + 1) / np.log(n + 2)
    out[10] = np.sqrt((words[1:] == words[:-1]).sum() / n)
    out[11] = np.sqrt(counts[10] / n)
    out[12] = (space - words.size) / max(b.size, 1)
    out[13] = kinds / n
    if words.size > 9:  # words that repeat a run of four
        a = words[:-3] * np.uint64(3) + words[1:-2] * np.uint64(5) + words[2:-1] * np.uint64(7) + words[3:]
        out[14] = 1 - np.unique(a).size / a.size
    out[15] = np.log1p(words.size) / 10
    return out


def _expanded(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    z = np.clip((x - scale[0]) / scale[1], -6, 6)
    return np.concatenate([z, np.abs(z), np.maximum(z - 1, 0)], axis=-1)


def moments(x: np.ndarray) -> np.ndarray:
    """Number, sums and sums of squares of a block's rows."""
    return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))


def scale_of(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, total, squares = sums[0], *np.split(sums[1:], 2)
    return total / n, np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0)) + 1e-6


def pair_weights(x: np.ndarray, y: np.ndarray, scale: tuple[np.ndarray, np.ndarray], seed: int = 3, steps: int = 400) -> np.ndarray:
    """Bradley-Terry weights from all pairs of each rejected document of a block with PAIRS preferred ones, times the number
    of pairs, and that number last."""
    z, rng = _expanded(x, scale), np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    if not good.size or not bad.size:
        return np.append(w, 0)
    lose = np.repeat(bad, PAIRS)
    win = rng.choice(good, lose.size)
    for t in range(1, steps + 1):
        s = z @ w
        p = 1 / (1 + np.exp(np.clip(s[win] - s[lose], -40, 40)))
        each = np.bincount(win, p, len(z)) - np.bincount(lose, p, len(z))  # a row's share in all its pairs, which are never laid out
        g = 1e-4 * w - (each @ z) / lose.size
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return np.append(w * lose.size, lose.size)


def counted(x: np.ndarray, y: np.ndarray, scale: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> pd.DataFrame:
    """step, good and bad: rows of a block by the step that their strength is in."""
    at = np.floor((_expanded(x, scale) @ w) / (6 * np.abs(w).sum() + 1e-9) * (STEPS // 2)).astype(np.int64)
    return pd.DataFrame({"step": at, "good": (y == 1).astype(np.int64), "bad": (y == 0).astype(np.int64)}).groupby("step", as_index=False).sum()


def model_of(scale: tuple[np.ndarray, np.ndarray], w: np.ndarray, counts: pd.DataFrame) -> dict:
    """The model. Its cut is near the quantile at the labels' rate, where the fewest training documents are on the wrong side."""
    counts = counts.sort_values("step")
    step, good, bad = (counts[c].to_numpy() for c in ("step", "good", "bad"))
    one = (6 * np.abs(w).sum() + 1e-9) / (STEPS // 2)
    n, rate = good.sum() + bad.sum(), bad.sum() / (good.sum() + bad.sum())
    below = np.concatenate(([0], (good + bad).cumsum()[:-1]))
    near = np.flatnonzero((below >= 0.5 * rate * n) & (below <= 1.5 * rate * n)) if step.size > 1 else np.arange(1)
    near = near if near.size else np.array([np.abs(below - rate * n).argmin()])
    wrong = ((good.cumsum() - good) + bad.sum() - (bad.cumsum() - bad))[near]
    edges = (step + np.concatenate((step[:1], step[:-1] + 1)))[near] / 2  # between a step and the one before that has rows
    cut = float(np.median(edges[wrong == wrong.min()])) * one
    middle = ((step + 0.5) * (good + bad)).sum() / n
    spread = float(np.sqrt((((step + 0.5 - middle) ** 2) * (good + bad)).sum() / n)) * one
    return {"scale": scale, "w": w, "cut": cut, "width": spread / 4 + 1e-9}


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 3, steps: int = 400) -> dict:
    """The model of one block's rows."""
    scale = scale_of(moments(x))
    w = pair_weights(x, y, scale, seed, steps)
    return model_of(scale, w[:-1] / w[-1], counted(x, y, scale, w[:-1] / w[-1]))


def strength(model: dict, x: np.ndarray) -> np.ndarray:
    z = (_expanded(x, model["scale"]) @ model["w"] - model["cut"]) / model["width"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, training: Column, sample: int | None = None) -> DataFrame:
    """o, text (bytes) and y of the training fold's rows; of about sample of them, the same ones whatever the partitions, where that is
    asked for. Labels that are too many for a broadcast make a filter, so texts without a label aren't shuffled."""
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("_id").isNotNull())
    own = own.groupBy("_id").agg(F.max("y").alias("y")).filter(training)
    if sample is not None and (n := own.count()) > sample:  # a threshold on all 64 bits of the hash
        own = own.filter(F.xxhash64("_id") < F.lit(-(1 << 63) + (sample << 64) // n))
    own = durable(own)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text"))
    if (n := own.count()) > LABELS and filter_fits(n):
        bits = bit_filter(own.select(F.xxhash64("_id").alias("h")), "h")

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_filter(bits, batch.column(2).to_numpy()))).select(["_id", "text"])

        texts = texts.filter("_id is not null").withColumn("h", F.xxhash64("_id")).mapInArrow(held, texts.schema)
    rows = texts.join(small(own, LABELS), "_id")
    return rows.withColumn("o", F.xxhash64("_id")).select("o", "text", "y")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in runs of SLICE rows, so that few texts at a time are copied out of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def blocks_of(rows: int) -> int:
    return max(1, -(-rows // BLOCK))


def train(docs: DataFrame, labels: DataFrame, training: Column) -> dict | None:
    """The model of all labelled rows; the driver gets sums, weights and counts of steps."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([features(raw).tobytes() for raw in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), x, batch.column(2)], ["o", "x", "y"])

    rows = durable(labelled(docs, labels, "quality", training).mapInArrow(measure, "o long, x binary, y int"))
    kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return None

    def packed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("o")
        return pd.DataFrame({"block": [int(f["block"].iloc[0])], "x": [b"".join(f["x"])], "y": [f["y"].to_numpy(np.int32).tobytes()]})

    many = blocks_of(sum(kinds.values()))
    blocks = durable(rows.withColumn("block", F.pmod("o", F.lit(many))).groupBy("block").applyInPandas(packed, "block long, x binary, y binary"))

    def over(step, schema: str) -> DataFrame:
        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for x, y in zip(f["x"], f["y"], strict=True):
                    yield step(np.frombuffer(x).reshape(-1, FEATURES), np.frombuffer(y, np.int32))

        return blocks.mapInPandas(each, schema)

    def summed(step) -> np.ndarray:
        parts = over(lambda x, y: pd.DataFrame({"k": range(len(s := step(x, y))), "v": s}), "k int, v double")
        # A block's numbers are added in their order, so that reruns agree.
        total = parts.groupBy("k").agg(F.aggregate(F.array_sort(F.collect_list("v")), F.lit(0.0), lambda a, v: a + v).alias("v"))
        return total.toPandas().sort_values("k")["v"].to_numpy()

    scale = scale_of(summed(lambda x, _: moments(x)))
    w = summed(lambda x, y: pair_weights(x, y, scale))
    if not w[-1]:
        return None
    w = w[:-1] / w[-1]
    counts = over(lambda x, y: counted(x, y, scale, w), "step long, good long, bad long")
    return model_of(scale, w, counts.groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas())


def _scoring(model: dict | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(raw) for raw in as_bytes(batch.column(1))]).reshape(-1, FEATURES)
            s = np.full(len(x), 0.5) if model is None else strength(model, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return score


def held_out(key: Column) -> Column:
    return fold(key, 3) == 1


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, labels, ~held_out(F.col("_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    out = texts.mapInArrow(_scoring(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's documents that the classifier accepts, each judged by its own text, in one pass."""
    model = train(docs, labels, ~held_out(F.col("_id")))
    names = docs.columns
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(raw) for raw in as_bytes(batch.column(at))]).reshape(-1, FEATURES)
            yield batch if model is None else batch.filter(pa.array(strength(model, x) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
