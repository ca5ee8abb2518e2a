"""The operators' queries against SQL, brute force, exact round trips and held-out labels."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from cuelake.llm import common, decontamination, dedup, language, mixing, quality, sharding, toxicity
from cuelake.llm.components import components
from cuelake.llm.queries import QUERIES
from cuelake.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_mix_reaches_targets(spark):
    rows = mixing.mix_report(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    per = rows.merge(docs[["doc_id", "source"]], on="doc_id").groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), least=("size", "min"))
    assert (per["target"] <= 3 * per["size"] + 1e-6).all() and abs(per["target"].sum() - per["size"].sum()) < 1e-3
    assert (rows["taken"] <= 3 * rows["size"]).all() and (per["taken"] <= per["target"] + 1e-6).all()
    # What is left of a budget is less than any document that the last partial round leaves out.
    rows = rows.merge(docs[["doc_id", "source"]], on="doc_id").merge((per["target"] - per["taken"]).rename("left"), left_on="source", right_index=True)
    out = rows[rows["copies"] == rows.groupby("source")["copies"].transform("min")].groupby("source").agg(left=("left", "first"), least=("size", "min"))
    partial = rows.groupby("source")["copies"].nunique() > 1
    assert (out["left"] < out["least"])[partial].mean() > 0.7 and (per["target"] - per["taken"]).sum() < 0.05 * per["target"].sum()
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per.index))}
    level = (per["target"] / per.index.map(weights)).where(per["target"] < 3 * per["size"] - 1e-6)
    assert level.max() - level.min() < 1e-6


# -- near duplicates ----------------------------------------------------------------------------------

def brute(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for k, s in sets.items():
        shared = Counter(j for g in s for j in holders[g] if j < k)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(k), root(j)))
                parent[b] = a
    members = defaultdict(list)
    for k in sets:
        members[root(k)].append(k)
    return {k: min(m) for m in members.values() for k in m}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    texts, k = {}, 0
    # A large group: few close copies, many too far from the first text, some of which are close to each other.
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    for _ in range(90):
        texts[k] = edited(base, rng.choice([0, 1, 2, 3, 5, 7, 9]), rng)
        k += 1
    far = edited(base, 8, rng).split()
    for _ in range(20):
        texts[k] = edited(far, 1, rng)
        k += 1
    # Chains: each text is close to the next one only.
    for _ in range(6):
        words = [f"c{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(5):
            texts[k] = " ".join(words)
            k += 1
            for at in rng.sample(range(120), 2):
                words[at] = f"n{rng.randrange(10**6)}"
    for _ in range(150):
        texts[k] = " ".join(f"u{rng.randrange(3000)}" for _ in range(rng.choice([2, 4, 5, 6, 40, 300])))
        k += 1
    texts[k], texts[k + 1], texts[k + 2] = None, "", texts[3].upper()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_near_duplicates_of_the_given_table(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.component_id for r in QUERIES["op7_near_duplicates"](spark, SF).collect()}
    assert got == brute(dict(zip(docs["doc_id"], docs["text"], strict=True)))


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[600:], rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
    ra, rb = dedup.registers(a), dedup.registers(b)
    true = 2400 / 3600
    estimate = dedup.joint_similarity(ra[None], rb[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(estimate - true) < 0.15
    assert (dedup.merged(ra, rb) == dedup.registers(np.union1d(a, b))).all()


def test_components(spark):
    path = [(k, k + 1) for k in range(100)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(101)} | {200: 200, 201: 200}


# -- words and windows -----------------------------------------------------------------------------------

def test_word_hashes_are_words():
    rng = random.Random(2)
    common._SEGMENT, whole = 64, common._SEGMENT
    try:
        for _ in range(50):
            text = "".join(rng.choice("ab é　\t\n\x0b9") for _ in range(rng.randrange(0, 400)))
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            h = common.word_hashes(text.encode(), common.SPACE_WORD_BYTES)
            assert h.size == len(words)
            assert len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))
    finally:
        common._SEGMENT = whole


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(12)]
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 12, 13, 14, 30]))) for k in range(30)}
    texts = {}
    for k in range(120):
        words = [rng.choice([*vocabulary, f"x{rng.randrange(400)}"] if rng.random() < 0.5 else ["é", "q"]) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = items[rng.randrange(30)].split()
        texts[k] = rng.choice([" ", "! ", ",\n"]).join(words).upper()
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, bench).collect()}
    for k, text in texts.items():
        words, hit, found = find(text), set(), set()
        for item, content in items.items():
            w = find(content)
            n = min(13, len(w))
            for s in range(len(w) - n + 1):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[s : s + n]:
                        hit |= set(range(at, at + n))
                        found.add(item)
        assert got[k] == (len(words), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(words)), k


# -- classifiers ------------------------------------------------------------------------------------------

def joined(rows, name):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    return rows.toPandas().merge(labels, on="doc_id").query("held_out")[["score", "predicted", name]]


def test_quality_of_held_out_documents(spark):
    rows = joined(QUERIES["op8_quality"](spark, "/root/testdata/sf0.01"), "quality")
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95 and rows["score"].between(0, 1).all()


def test_toxicity_of_held_out_documents(spark):
    train = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    texts, y = [toxicity.word_ids(t.encode()) for t in train["text"]], train["toxic"].to_numpy()
    model = toxicity.fit(texts[:2500], y[:2500], epochs=2)
    z = toxicity.logits(model, texts[2500:])
    order = np.argsort(-z)[: int(y[2500:].sum())]
    assert y[2500:][order].mean() > 0.75


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op5_languages"](spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]], on="doc_id").query("held_out")
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.98


def test_mixed_languages():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(50, 0.2), 3)
    counts = rng.multinomial(600, 0.6 * p[0] + 0.4 * p[2]).astype(float)
    shares = language.mixture(counts, p, np.log(p))
    assert abs(shares[0] - 0.6) < 0.1 and abs(shares[2] - 0.4) < 0.1 and shares[1] == 0
    assert language.mixture(rng.multinomial(600, p[1]).astype(float), p, np.log(p)).tolist() == [0, 1, 0]


def test_bradley_terry_orders():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, quality.FEATURES))
    y = (x[:, 0] - x[:, 3] > -0.8).astype(int)
    model = quality.fit_pairs(x, y)
    assert ((quality.strength(model, x) >= 0.5) == y).mean() > 0.93


# -- sharding ----------------------------------------------------------------------------------------------

def test_transfers_move_the_least():
    rng = random.Random(4)
    for _ in range(20):
        m, n = rng.randint(1, 6), rng.randint(1, 8)
        sizes = [rng.randint(0, 50) for _ in range(m)]
        total = sum(sizes)
        caps = [total * (j + 1) // n - total * j // n for j in range(n)]
        flow = sharding.min_cost_transfers(sizes, caps)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(m)] == sizes
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(n)] == caps
        stay = sum(min(a, b) for a, b in zip(sizes, caps, strict=False))
        assert sum(v for (i, j), v in flow.items() if i == j) == stay


def test_transfers_by_cost():
    cost = [[0, 5, 1], [4, 0, 9]]
    flow = sharding.min_cost_transfers([10, 6], [4, 4, 8], lambda i, j: cost[i][j])
    assert flow == {(0, 0): 2, (0, 2): 8, (1, 0): 2, (1, 1): 4} or sum(cost[i][j] * v for (i, j), v in flow.items()) == 16


def test_shards_are_even_and_files_whole(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") * F.col("id") % 97).cast("int")).alias("text"))
    rows = sharding.reshard_files(docs, 7, 5).toPandas()
    sizes = rows.assign(b=rows["text"].str.len() + 16).groupby("shard")["b"].sum()
    assert len(sizes) == 7 and sizes.max() - sizes.min() < 0.01 * sizes.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert sorted(zip(rows["doc_id"], rows["text"], strict=True)) == sorted(map(tuple, docs.collect()))
    again = sharding.reshard_files(docs.repartition(9), 7, 5).toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, rows.to_numpy()))
    where = dict(zip(rows["doc_id"], rows["shard"], strict=True))
    laid = spark.createDataFrame([(int(k), int(v)) for k, v in where.items()], "doc_id long, at int").join(docs, "doc_id")
    assert sharding.reshard_files(laid, 7, 7, F.col("at")).filter("move").count() < 60
