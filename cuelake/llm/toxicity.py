"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its beginnings; filters of width one, two and three slide over them, each keeps its
maximum over the whole text, and a logistic layer weighs the maxima. All weights start at random and are learnt by
gradient steps that shrink with each weight's past gradients (Adagrad). Decision thresholds are calibrated by language, which the
language model of this package reads from the text; the score is shifted so that 0.3 is the threshold everywhere.

Every labelled row of the training fold teaches or calibrates. Rows go by hash to blocks of about BLOCK rows; in each epoch every block
takes its gradient steps from the same weights, and the mean of what the blocks changed is the next epoch's start (an
embedding's: of the blocks that have it). Thresholds are over the logits of all calibration rows, counted in fine steps. Scoring
reads whole texts, long ones in pieces that overlap.

Edge cases: empty and null texts get the score of no words; without labels of both kinds all documents score 0;
repeated labels of a document count once; other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import language
from cuelake.llm.common import as_bytes, byte_class, durable, word_hashes
from cuelake.llm.quality import labelled

#: Labelled rows of a block. Epochs, however many blocks there are. Steps of a logit that are counted, and embeddings summed at a time.
BLOCK, EPOCHS, STEPS, CHUNK = 4_000, 6, 256, 1 << 10
TABLE, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: Lengths, in bytes, of the word beginnings that share embeddings; the whole word comes first.
PREFIXES = (4, 5, 6, 7, 8)
PIECE = 1 << 12
#: The score at which a document counts as toxic.
THRESHOLD = 0.3
#: Letters, digits and all beyond ASCII.
_WORD = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def word_ids(raw: bytes | None) -> np.ndarray:
    """A row per word: places of the word and of its beginnings in the table; 0 where it is shorter."""
    if not raw:
        return np.empty((0, 1 + len(PREFIXES)), np.int32)
    whole, parts = word_hashes(raw.lower(), _WORD, PREFIXES)
    ids = (np.column_stack([whole, *parts]) % np.uint64(TABLE - 1) + np.uint64(1)).astype(np.int32)
    for k, part in enumerate(parts):
        ids[part == 0, k + 1] = 0
    return ids


_COLUMNS = [(k, j) for k, width in enumerate(WIDTHS) for j in range(width)]


def _embedded(model: dict, ids: np.ndarray) -> np.ndarray:
    out = model["e"].take(ids[:, 0], axis=0)  # a column at a time, so the table of a text's embeddings is never laid out
    for k in range(1, ids.shape[1]):
        out += model["e"].take(ids[:, k], axis=0)
    return out


def _pooled(model: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of all filters over the text and where they are; -1 where none is above 0."""
    best, where = np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), -1)
    flat = np.concatenate([model["w"][k][j] for k, j in _COLUMNS], axis=1)
    for at in range(0, len(ids), PIECE):
        x = _embedded(model, ids[at : at + PIECE + max(WIDTHS) - 1]) @ flat
        for k, width in enumerate(WIDTHS):
            n = len(x) - width + 1
            if n <= 0:
                continue
            first = FILTERS * _COLUMNS.index((k, 0))
            sums = x[:n, first : first + FILTERS] + model["b"][k]
            for j in range(1, width):
                sums = sums + x[j : j + n, first + j * FILTERS : first + (j + 1) * FILTERS]
            top = sums.argmax(axis=0)
            value, part = sums[top, np.arange(FILTERS)], slice(k * FILTERS, (k + 1) * FILTERS)
            where[part] = np.where(value > best[part], top + at, where[part])
            best[part] = np.maximum(best[part], value)
    return best, where


def begin(rng: np.random.Generator) -> tuple[dict, list[np.ndarray]]:
    """Random weights, and the past gradients of the dense ones and of the embeddings."""
    e = rng.normal(0, 0.05, (TABLE, DIM)).astype(np.float32)
    e[0] = 0
    model = {"e": e, "w": [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], "b": [np.zeros(FILTERS, np.float32) for _ in WIDTHS], "v": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.zeros(1, np.float32)}
    return model, [*(np.full_like(x, 1e-6) for x in _dense(model)), np.full(TABLE, 1e-6, np.float32)]


def _dense(model: dict) -> list[np.ndarray]:
    return [*model["w"], *model["b"], model["v"], model["c"]]


def class_weights(n: np.ndarray) -> np.ndarray:
    return n.sum() / (2 * np.maximum(n, 1))


def epoch(model: dict, past_of: list[np.ndarray], texts: list[np.ndarray] | Texts, y: np.ndarray, weight: np.ndarray, order: np.ndarray, batch: int = 32, rate: float = 0.1) -> None:
    """Gradient steps over all texts in order; the model and the past gradients change in place."""
    e, dense, (*seen, seen_e) = model["e"], _dense(model), past_of
    for at in range(0, len(order), batch):
        slopes = [np.zeros_like(x) for x in dense]
        gw, gb, (gv, gc) = slopes[: len(WIDTHS)], slopes[len(WIDTHS) : 2 * len(WIDTHS)], slopes[2 * len(WIDTHS) :]
        found = [([], [], [], []) for _ in WIDTHS]  # of a width: which text, which filters, their slopes and the words they are over
        for n, i in enumerate(order[at : at + batch]):
            words = texts[i]
            best, where = _pooled(model, words)
            d = np.float32((1 / (1 + np.exp(-np.clip(best @ model["v"] + model["c"][0], -30, 30))) - y[i]) * weight[i])
            gv += d * best
            gc += d
            for k, width in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                cols = np.flatnonzero(where[part] >= 0)
                for x, own in zip(found[k], (np.full(cols.size, n), cols, d * model["v"][part][cols], words[where[part][cols][:, None] + np.arange(width)]), strict=True):
                    x.append(own)
        places, rows, turns = [], [], []
        for k, width in enumerate(WIDTHS):
            of, cols, s, ids = map(np.concatenate, found[k])
            np.add.at(gb[k], cols, s)
            for j in range(width):
                np.add.at(gw[k][j].T, cols, _embedded(model, ids[:, j]) * s[:, None])
                places.append(ids[:, j])
                rows.append((model["w"][k][j][:, cols] * s).T)
                turns.append((of * len(WIDTHS) + k) * max(WIDTHS) + j)
        turn = np.argsort(np.concatenate(turns), kind="stable")  # embeddings are summed text by text
        places = np.concatenate(places)[turn]
        rows = np.repeat(np.concatenate(rows)[turn], places.shape[1], axis=0)
        for x, g, past in zip(dense, slopes, seen, strict=True):
            past += g * g
            x -= rate * g / np.sqrt(past)
        at_e, own = np.unique(places.ravel(), return_inverse=True)
        g = np.zeros((at_e.size, DIM), np.float32)
        np.add.at(g, own, rows)
        seen_e[at_e] += (g * g).mean(axis=1)
        e[at_e] -= rate * g / np.sqrt(seen_e[at_e])[:, None]
        e[0] = 0


def fit(texts: list[np.ndarray] | Texts, y: np.ndarray, epochs: int = 6, batch: int = 32, seed: int = 5, rate: float = 0.1) -> dict:
    """The model of one block."""
    rng = np.random.default_rng(seed)
    model, past = begin(rng)
    weight = class_weights(np.array([(y == 0).sum(), (y == 1).sum()]))[y]
    for _ in range(epochs):
        epoch(model, past, texts, y, weight, rng.permutation(len(texts)), batch, rate)
    return model


def logits(model: dict, texts: list[np.ndarray] | Texts) -> np.ndarray:
    return np.array([_pooled(model, ids)[0] @ model["v"] + model["c"][0] for ids in texts], float).reshape(-1)


def calibrate(z: np.ndarray, good: np.ndarray, bad: np.ndarray, groups: np.ndarray, count: int, least: int = 60) -> np.ndarray:
    """The logit threshold of each language with the best F1, from how many rows of label 0 (good) and 1 (bad) have logit z;
    languages with few labels take that of all."""
    def cut(own, default):
        at, place = np.unique(-z[own], return_inverse=True)
        hits, others = (np.bincount(place, x[own], at.size) for x in (bad, good))
        if hits.sum() < 10 or others.sum() < 10:
            return default
        f1 = 2 * hits.cumsum() / ((hits + others).cumsum() + hits.sum())
        k = int(np.argmax(f1))
        return -(at[k] + at[min(k + 1, at.size - 1)]) / 2

    overall = cut(np.ones(z.size, bool), 0.0)
    many = lambda k: (good + bad)[groups == k].sum() >= least
    return np.array([cut(groups == k, overall) if many(k) else overall for k in range(count)] + [overall])


def _language_of(raw: bytes | None, langs: list[str], log_p: np.ndarray) -> int:
    """The likeliest language; the number of languages for texts without letters."""
    if not langs or not raw:
        return len(langs)
    counts = language.trigrams(raw.decode(errors="ignore"))
    return int(np.argmax(log_p @ counts)) if counts.any() else len(langs)


class Texts:
    """Texts as places in a table of distinct words' ids; a text's ids are looked up when it is its turn."""

    def __init__(self, table: np.ndarray, places: list[np.ndarray]):
        self.table, self.places = table, places

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.table[self.places[k]]

    def where(self, flags: np.ndarray) -> Texts:
        return Texts(self.table, [x for x, f in zip(self.places, flags, strict=True) if f])


def word_keys(raw: bytes | None) -> np.ndarray:
    """32 bits of every word's hash, in the order of word_ids()."""
    return (word_hashes(raw.lower(), _WORD) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if raw else np.empty(0, np.uint32)


def _packed(f: pd.DataFrame, langs: list[str], log_p: np.ndarray) -> pd.DataFrame:
    """A block's row: places of its words in the table of its distinct words' ids, labels, languages, and which rows calibrate."""
    f = f.sort_values("o")
    raws = [None if r is None else bytes(r) for r in f["text"]]
    keys = [word_keys(r) for r in raws]
    known = np.unique(np.concatenate(keys))
    places, table = [np.searchsorted(known, k).astype(np.int32) for k in keys], np.zeros((known.size, 1 + len(PREFIXES)), np.int32)
    for r, at in zip(raws, places, strict=True):
        table[at] = word_ids(r)
    y, own = f["y"].to_numpy(np.int32), f["o"].to_numpy() % 4 == 0  # calibrated on what the filters aren't fitted to
    lang = np.array([_language_of(r, langs, log_p) for r in raws], np.int32)
    out = {"words": table, "places": np.concatenate(places), "sizes": np.array([x.size for x in places], np.int32), "y": y, "lang": lang, "own": own}
    ones = {f"{name}{k}": [int((y[rows] == k).sum())] for name, rows in (("all", slice(None)), ("fit", ~own)) for k in (0, 1)}
    return pd.DataFrame({"block": [int(f["block"].iloc[0])]} | {k: [v.tobytes()] for k, v in out.items()} | ones)


def _unpacked(r) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    places = np.split(np.frombuffer(r.places, np.int32), np.frombuffer(r.sizes, np.int32).cumsum()[:-1])
    texts = Texts(np.frombuffer(r.words, np.int32).reshape(-1, 1 + len(PREFIXES)), places)
    return texts, np.frombuffer(r.y, np.int32), np.frombuffer(r.lang, np.int32), np.frombuffer(r.own, bool)


def _next(blocks: DataFrame, model: dict, past: list[np.ndarray], weights: np.ndarray, number: int) -> None:
    """An epoch over all blocks. Changes are summed by parts of the weights on the executors."""
    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = lambda m, p: np.concatenate([x.ravel() for x in (*_dense(m), *p[:-1])])
        wide = lambda m, p: np.column_stack([m["e"], p[-1]])
        before, before_e, first = flat(model, past).astype(float), wide(model, past), None
        total, total_e = np.zeros(before.size + 1), np.zeros((TABLE, DIM + 2), np.float32)
        for f in frames:
            for r in f.itertuples():
                texts, y, _, own = _unpacked(r)
                texts, y = texts.where(~own), y[~own]
                m = {k: [x.copy() for x in v] if isinstance(v, list) else v.copy() for k, v in model.items()}
                p = [x.copy() for x in past]
                epoch(m, p, texts, y, weights[y], np.random.default_rng([5, number, r.block]).permutation(len(texts)))
                total += np.append(flat(m, p) - before, 1)
                change = wide(m, p) - before_e
                total_e += np.column_stack([change, change[:, -1] > 0])
                first = r.block if first is None else first
        if first is not None:
            yield pd.DataFrame({"part": [-1], "first": [first], "data": [total.tobytes()]})
            for k in range(0, TABLE, CHUNK):
                if total_e[k : k + CHUNK, -1].any():
                    yield pd.DataFrame({"part": [k], "first": [first], "data": [total_e[k : k + CHUNK].tobytes()]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        part = f["part"].iloc[0]
        kind = float if part < 0 else np.float32  # embeddings travel as they are and are summed in double
        return pd.DataFrame({"part": [part], "data": [np.sum([np.frombuffer(x, kind) for x in f.sort_values("first")["data"]], axis=0, dtype=float).tobytes()]})

    for r in blocks.mapInPandas(learn, "part long, first long, data binary").groupBy("part").applyInPandas(add, "part long, data binary").toLocalIterator():
        data = np.frombuffer(r["data"])
        if r["part"] < 0:
            mean, at = data[:-1] / data[-1], 0
            for x in (*_dense(model), *past[:-1]):
                x += mean[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        else:
            rows, part = data.reshape(-1, DIM + 2), slice(r["part"], r["part"] + CHUNK)
            mean = rows[:, :-1] / np.maximum(rows[:, -1:], 1)
            model["e"][part] += mean[:, :DIM].astype(np.float32)
            past[-1][part] += mean[:, DIM].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model of all labelled rows. Texts and their words stay on the executors; the driver gets changes of the weights and counts."""
    langs, p = language.learn(docs, ~language.held_out(F.col("doc_id")))
    log_p = np.log(p)
    training = ~language.held_out(F.col("_id"))
    n = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("y")).filter("y IN (0, 1)").filter(training).count()
    many = max(1, -(-n // BLOCK))
    rows = labelled(docs, labels, "toxic", training).withColumn("block", F.pmod(F.shiftright("o", 8), F.lit(many)))
    columns = "block long, words binary, places binary, sizes binary, y binary, lang binary, own binary, all0 long, all1 long, fit0 long, fit1 long"
    blocks = durable(rows.groupBy("block").applyInPandas(lambda f: _packed(f, langs, log_p), columns))
    of = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("all0", "all1", "fit0", "fit1"))).first()
    if not of["all0"] or not of["all1"]:
        return None
    model, past = begin(np.random.default_rng(5))
    for k in range(EPOCHS):
        _next(blocks, model, past, class_weights(np.array([of["fit0"], of["fit1"]])), k)

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                texts, y, lang, own = _unpacked(r)
                z = np.round(logits(model, texts.where(own)) * STEPS).astype(np.int64)
                yield pd.DataFrame({"z": z, "lang": lang[own], "y": y[own]})

    counts = blocks.mapInPandas(steps, "z long, lang int, y int").groupBy("z", "lang").agg(F.count_if(F.col("y") == 0).alias("good"), F.count_if(F.col("y") == 1).alias("bad")).toPandas()
    cuts = calibrate(counts["z"].to_numpy() / STEPS, *(counts[c].to_numpy() for c in ("good", "bad", "lang")), len(langs))
    return model | {"langs": langs, "log_p": log_p, "cuts": cuts}


def score(model: dict, z: np.ndarray, groups: np.ndarray) -> np.ndarray:
    shift = np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(z - model["cuts"][groups] + shift, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, labels)

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = as_bytes(batch.column(1))
            s = np.zeros(len(raws))
            if model and raws:
                s = score(model, logits(model, [word_ids(r) for r in raws]), np.array([_language_of(r, model["langs"], model["log_p"]) for r in raws]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    out = texts.mapInArrow(scoring, "doc_id long, score double")
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
