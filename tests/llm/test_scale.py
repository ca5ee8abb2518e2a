"""Long passages, hostile groups and whole stages."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_results import brute

import corpus_pipeline
from cuelake.llm import decontamination, dedup

SF = "/root/testdata/sf0.001"


def test_a_long_shared_passage_stays_linear(spark):
    """Shingles of a copied item of 20,000 words travel without its words."""
    item = " ".join(f"w{k * k % 7919}x{k % 31}" for k in range(20_000))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, item), (3, "nothing of it")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert rows == {1: (20_002, 20_000, 1, True), 2: (20_000, 20_000, 1, True), 3: (3, 0, 0, False)}
    found = list(decontamination._scanner(__import__("numpy").full(8192, 255, "u1"), [(4, 13)])(iter([__import__("pyarrow").record_batch([[1], [item], ["d"]], names=["a", "b", "c"])])))[0]
    runs = found.column(3).to_pylist()[0]
    assert sum(len(r["words"]) for r in runs) < 1.3 * 20_000 and max(len(r["words"]) for r in runs) == decontamination.CHUNK


@pytest.mark.parametrize("seed", [1])
def test_templates_of_every_overlap(spark, seed):
    """Groups around one template whose pairs lie on both sides of the threshold: the exact join across components finds what is left."""
    rng, texts = random.Random(seed), {}
    for share in (0.95, 0.9, 0.87, 0.85, 0.83, 0.8, 0.75):
        base = [f"t{share}_{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(30):
            n, words = int(200 * (1 - share)), list(base)
            at = rng.randrange(200 - n + 1)
            words[at : at + n] = [f"q{rng.randrange(10**9)}" for _ in range(n)]
            texts[len(texts)] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in dedup.near_duplicates(docs).collect()} == brute(texts)


def test_recall_against_all_pairs(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == brute(dict(zip(docs["doc_id"], docs["text"], strict=True)))


def test_rows_are_judged_by_their_own_text(spark):
    same, other = "a b c d e f g", "zz yy xx ww vv uu tt ss rr qq pp oo nn mm"
    docs = spark.createDataFrame([(1, same), (1, same), (1, other), (None, same), (None, None), (None, other.upper()), (2, same.upper()), (3, ""), (3, "")], "doc_id long, text string")
    left = sorted((str(r.doc_id), str(r.text)) for r in dedup.deduplicated(docs).collect())
    assert left == [("1", same), ("1", other), ("3", ""), ("None", "None")]
    bench = spark.createDataFrame([("i", other)], "item_id string, text string")
    left = sorted((str(r.doc_id), str(r.text)) for r in decontamination.decontaminated(docs, bench).collect())
    assert left == [("1", same), ("1", same), ("2", same.upper()), ("3", ""), ("3", ""), ("None", "None"), ("None", same)]


def test_the_pipeline_stage_by_stage(spark):
    """Every stage on what its predecessor kept, against what the operator's own report or brute force says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, docs, SF).toPandas())
        docs = spark.createDataFrame(kept[-1])
    whole = pd.read_parquet(f"{SF}/documents.parquet")
    assert 0.5 * len(whole) < len(kept[0]) < len(whole)
    groups = brute(dict(zip(kept[0]["doc_id"], kept[0]["text"], strict=True)))
    assert sorted(kept[1]["doc_id"]) == sorted(k for k, c in groups.items() if k == c)
    bad = {r.doc_id for r in decontamination.contamination(spark.createDataFrame(kept[1]), spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    assert sorted(kept[2]["doc_id"]) == sorted(set(kept[1]["doc_id"]) - bad)
    assert set(kept[3]["doc_id"]) <= set(kept[2]["doc_id"]) and kept[3]["doc_id"].value_counts().max() <= 3
    assert sorted(kept[4]["doc_id"]) == sorted(kept[3]["doc_id"]) and {"shard", "slot"} <= set(kept[4].columns)


def test_run_gives_what_its_stages_give(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
