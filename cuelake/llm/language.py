"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods.

Letter trigrams are hashed to DIMS places and counted per language over the whole training fold. A document is a
mixture of languages; their shares maximise the likelihood of its trigrams. The set of languages starts with the
likeliest one and grows while the likelihood, less half the logarithm of the trigrams' number per language, does.
Whether any further language can help at all is seen from the gradient, so most documents need no iteration.

Edge cases: a text without letters, or null, is und with score 0; a text whose letters make no trigram goes to the
most frequent language; without training rows all is und; null languages aren't learnt; rows that repeat are
learnt as often as they occur; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import fold, mixed

DIMS = 8192
SMOOTH = 0.1
_WORDLIKE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased letters, words apart; empty when there are none."""
    raw = np.frombuffer((text or "").lower().encode().translate(_WORDLIKE), np.uint8)
    if raw.size < 3:
        return np.zeros(DIMS)
    a, b, c = (raw[k : raw.size - 2 + k].astype(np.uint32) for k in range(3))
    at = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) >> np.uint32(15)) % np.uint32(DIMS)
    return np.bincount(at[(b != 0x20) & ((a != 0x20) | (c != 0x20))], minlength=DIMS).astype(float)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + trigrams(text)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "place", "n"])


def learn(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray]:
    """Languages, the most frequent first, and their trigram probabilities. What the driver gets is languages x DIMS counts."""
    rows = docs.filter(F.col("lang").isNotNull() & training).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(_counting, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    totals = sums.groupby("lang")["n"].sum().sort_index().sort_values(ascending=False, kind="stable")
    langs = list(totals.index)
    p = np.full((len(langs), DIMS), SMOOTH)
    for k, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        p[k, own["place"].to_numpy()] += own["n"].to_numpy()
    return langs, p / p.sum(axis=1, keepdims=True)


def mixture(counts: np.ndarray, p: np.ndarray, log_p: np.ndarray, steps: int = 40) -> np.ndarray:
    """Shares of the languages in a document."""
    at = np.flatnonzero(counts)
    shares = np.zeros(len(p))
    c, total = counts[at], counts.sum()
    q, single = p[:, at], log_p[:, at] @ c
    active = [int(np.argmax(single))]
    shares[active[0]] = 1
    best = single[active[0]]
    while len(active) < len(p):
        gain = (q / (shares @ q)) @ c / total  # above 1: more of this language raises the likelihood
        gain[active] = 0
        new = int(np.argmax(gain))
        if gain[new] <= 1 + np.log(total) / (2 * total):
            break
        trial = active + [new]
        s = np.full(len(trial), 1 / len(trial))
        for _ in range(steps):
            r = s[:, None] * q[trial]
            s = (r / r.sum(axis=0)) @ c / total
        value = np.log(s @ q[trial]) @ c
        if value - best <= np.log(total) / 2:
            break
        active, best = trial, value
        shares[:] = 0
        shares[active] = s
    return shares


def _naming(langs: list[str], p: np.ndarray):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = np.log(p)
        for batch in batches:
            names, scores, mixes = [], [], []
            for text, letters in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not letters or not langs:
                    names.append("und")
                    scores.append(0.0)
                    mixes.append([])
                    continue
                counts = trigrams(text)
                shares = mixture(counts, p, log_p) if counts.any() else np.eye(len(langs))[0]
                k = int(np.argmax(shares))
                names.append(langs[k])
                scores.append(float(min(1.0, shares[k])))
                mixes.append([{"lang": langs[i], "share": float(shares[i])} for i in np.flatnonzero(shares)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)], ["doc_id", "lang_pred", "score", "mixture"])

    return name


def held_out(key: Column) -> Column:
    return fold(key, 4) == 2


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the share of that language) and mixture for every document."""
    langs, p = learn(docs, ~held_out(F.col("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.withColumn("letters", has_letter(F.col("text"))).mapInArrow(_naming(langs, p), "doc_id long, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
