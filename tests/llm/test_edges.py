"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import gzip
import json
import os
import random
import re

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from cuelake.llm import chat, common, decontamination, dedup, language, mixing, quality, rules, sharding, toxicity, warc
from cuelake.llm.sql import ORACLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves or return.
CLASHES = ["size", "score", "kept", "shard", "slot", "move", "key", "n", "target", "copies", "taken", "source_size", "predicted", "_n", "_h", "_src", "held_out", "html", "words", "runs", "n_words", "band", "label"]


def prose(k, words=60):
    r = random.Random(k)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(r.randint(0, 60)) for _ in range(words))


def weird():
    rows = [(k, prose(k), ["en", "de", None][k % 3], f"s{k % 4}", 0) for k in range(60)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", None, 0), (102, "   \n\t ", None, None, 0), (103, "...", "en", "s1", 3), (104, "one", "de", "s1", 3)]
    rows += [(None, prose(5), "en", "s1", 1), (None, None, None, None, None), (None, prose(200), None, None, None)]
    rows += [(7, prose(7), "en", "s3", 0)] * 3 + [(110 + k, prose(3), "en", "s0", 0) for k in range(25)]
    rows += [(150, " ".join(prose(k, 3000) for k in range(5)), "en", "s2", 0), (151, "x" * 5_000_000, "en", "s2", 0), (152, "na " * 5000, "en", "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(weird(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 5 > 0), int(k % 7 == 0)) for k in range(60)] + [(None, 1, 0), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(3, 30)), (2, "one"), (3, None), (4, ""), (5, prose(3, 30)), (6, "...")], "item_id long, text string").withColumn("words", F.lit("clash"))


OPERATORS = {
    "mix": lambda d, lab, b: mixing.mix_report(d), "mix_rows": lambda d, lab, b: mixing.mix_sources(d), "shards": lambda d, lab, b: sharding.shard_report(d), "shard_files": lambda d, lab, b: sharding.reshard_files(d),
    "languages": lambda d, lab, b: language.languages(d), "toxicity": lambda d, lab, b: toxicity.toxicity_scores(d, lab), "near": lambda d, lab, b: dedup.near_duplicates(d), "near_rows": lambda d, lab, b: dedup.deduplicated(d),
    "quality": lambda d, lab, b: quality.quality_scores(d, lab), "quality_rows": lambda d, lab, b: quality.accepted(d, lab), "rules": lambda d, lab, b: rules.quality_rules(d), "decontaminate": lambda d, lab, b: decontamination.contamination(d, b),
    "decontaminate_rows": lambda d, lab, b: decontamination.decontaminated(d, b),
}
PER_ROW = {"mix", "shards", "languages", "toxicity", "near", "quality", "rules", "decontaminate"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(docs, clashing, labels, bench, name):
    rows = OPERATORS[name](docs, labels, bench).collect()
    if name in PER_ROW:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in weird())
    again = OPERATORS[name](clashing, labels.withColumn("text", F.lit("clash")), bench)
    if name in PER_ROW:
        assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    else:
        assert again.count() == len(rows)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(docs, labels, bench, name):
    out = OPERATORS[name](docs.limit(0), labels.limit(0), bench.limit(0))
    assert out.count() == 0
    if name in PER_ROW:
        assert OPERATORS[name](docs, labels.limit(0), bench.limit(0)).count() == docs.count()


def test_near_duplicates_of_odd_rows(docs):
    rows = dedup.near_duplicates(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for k in (100, 101, 102) for r in by[k])
    assert {r.component_id for k in range(110, 135) for r in by[k]} == {3}
    assert by[104][0].n_shingles == 1 and by[152][0].n_shingles == 1
    assert sorted(r.component_id or -1 for r in by[None]) == [-1, -1, 5]


def test_rules_of_odd_rows(spark, docs, duck):
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE documents AS SELECT * FROM (SELECT 1::BIGINT AS doc_id, ''::VARCHAR AS text, ''::VARCHAR AS lang, ''::VARCHAR AS source, 0::BIGINT AS n_chars) LIMIT 0")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r for r in weird() if r[0] is not None and (r[0] != 7) and r[0] != 151])
    kept = docs.filter("doc_id is not null and doc_id not in (7, 151)")
    same_rows(rules.quality_rules(kept), con, ORACLES["op9_quality_rules"])


def test_boilerplate_limit_does_not_grow_with_the_host(spark):
    # 25 documents of a host of 2,000 share a line: under 2 % of it, and more than 20.
    big = [(k, prose(k, 40) + ("\n" + prose(9000, 20) if k < 25 else ""), "big") for k in range(2000)]
    # 30 copies of a text are 30 documents that share its lines; 20 documents are within the limit, as are repeated rows of one.
    small = [(3000 + k, prose(9001, 40), "copies") for k in range(30)] + [(4000 + k, prose(k, 40) + "\n" + prose(9002, 20), "twenty") for k in range(20)] + [(5000, prose(9003, 40), "rows")] * 30
    small += [(None, prose(9004, 40), "no ids")] * 30
    docs = spark.createDataFrame(big + small, "doc_id long, text string, source string")
    removed = [((r.doc_id, r.n_removed_words), r.kept) for r in rules.quality_rules(docs).collect()]
    lost = lambda k, t, s: 40 if s in ("copies", "no ids") else 20 if k is not None and k < 25 else 0
    assert sorted(map(str, removed)) == sorted(str(((k, lost(k, t, s)), lost(k, t, s) < 40)) for k, t, s in big + small)
    texts = {(r.doc_id, r.n_removed_words) for r in rules.quality_rules(docs, by="texts").collect()}
    assert texts == {(k, 20 if k is not None and k < 25 else 0) for k, *_ in big + small}


def test_a_source_at_its_cap_is_taken_no_fourth_time(spark):
    """One source is tiny beside its weight: its target stops at three times its size, empty texts included."""
    rows = [(k, f"{prose(k, 12)}", "a") for k in range(10)] + [(100 + k, None if k % 2 else " ", "a") for k in range(10)] + [(1000 + k, prose(k, 100), "b") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = mixing.mix_report(docs).collect()
    assert {r.copies for r in report if r.doc_id < 1000} == {3} and max(r.copies for r in report) <= 3
    assert mixing.mix_sources(docs).filter("doc_id < 1000").count() == 60


PAGES = "page_id long, url string, html string"


def test_archives(spark):
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "http://d\r\nX: y", ""), (None, "http://e", "x"), (2, "http://b", "x"), (9, "http://l", "long " * 300_000), (10, "http://m", "ü\r\n\r\nü"), (None, None, None)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"revisit": F.lit("clash"), "shard": F.lit(1), "_digest": F.lit("x")})
    got = warc.archive_report(pages).collect()
    found = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert found == sorted([("1", 1, "revisit", 2), ("2", 1, "response", None), ("2", 1, "response", None), ("3", 0, "revisit", 4), ("4", 0, "response", None), ("None", 1, "revisit", 2), ("9", 1_500_000, "response", None), ("10", 8, "response", None), ("None", 0, "revisit", 4)])
    assert {r.payload_digest for r in got if r.payload_bytes == 0} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_archives_of_uneven_ids(spark):
    """Ranges of page_ids hold where ids lie unevenly, at the ends of 64 bits, or tie."""
    rows = [(k, f"u{k}", "x" * (k % 300)) for k in range(3000)] + [(10**15, "a", "y"), (-(2**63), "b", "z"), (2**63 - 1, "c", "w")]
    rows += [(77_777, f"v{k}", f"{k} " * 60) for k in range(900)] + [(None, f"n{k}", f"{k} " * 60) for k in range(900)]
    folder = warc.new_folder(spark, "warc")
    files = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(5), folder, shard_bytes=60_000).orderBy("name").collect()
    last, null_shards, tied = None, set(), set()
    for f in files:
        ids = [int(x) for x in re.findall(rb"X-Page-Id: (-?\d+)", gzip.open(f.name).read())]
        assert ids == sorted(ids) and (not ids or last is None or last <= ids[0])
        last = ids[-1] if ids else last
        null_shards |= {f.shard} if len(ids) < f.records else set()
        tied |= {f.shard} if 77_777 in ids else set()
    assert len({f.shard for f in files}) > 20 and max(f.bytes for f in files) < 200_000 and len(null_shards) > 3 and len(tied) > 3
    back = warc.read_archives(spark, folder)
    assert sorted((str(r.page_id), str(r.url), bytes(r.payload or b"").decode()) for r in back.filter("record_type = 'response'").collect()) == sorted((str(a), b, c) for a, b, c in _responses(rows))
    assert not os.path.exists(f"{folder.removeprefix('file:')}/temporary")


def _responses(rows):
    """Of rows with equal payloads those with the largest id; null is the largest only of nulls."""
    low = lambda a: -(2**63) - 1 if a is None else a
    top = {}
    for a, _, c in rows:
        top[c] = max(top.get(c, low(None)), low(a))
    return [(a, b, c) for a, b, c in rows if low(a) == top[c]]


def test_archives_are_deterministic_and_roll(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", prose(k, 400)) for k in range(200)], PAGES)
    found = []
    for n in (2, 7):
        folder = warc.new_folder(spark, "warc")
        manifest = warc.write_archives(pages.repartition(n), folder, shard_bytes=200_000, roll_bytes=20_000)
        found.append(sorted((r.shard, r.seq, r.records, r.bytes, r.sha1) for r in manifest.collect()))
        back = warc.read_archives(spark, folder)
        assert sorted((r.page_id, bytes(r.payload).decode()) for r in back.collect()) == [(k, prose(k, 400)) for k in range(200)]
    assert found[0] == found[1] and max(s for _, s, *_ in found[0]) > 0 and len({s for s, *_ in found[0]}) > 1


def test_chat_links(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "search", '{"query":"x","limit":3}', []), (1, "b", 3, "search", '{ "limit" : "3", "query":"é", "z":{"b":1,"a":[2]} }', ["a", "nope"]), (1, "b", 5, "search", "{}", []),
        (1, "c", 5, "other", "not json", ["d"]), (1, "d", 7, "lookup", None, ["c"]), (1, None, 9, "search", "{}", []), (None, "n", 1, "search", "{}", None),
    ], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>").withColumn("level", F.lit(1))
    results = spark.createDataFrame([(1, "a", 2, "ok"), (1, "b", 1, "early"), (1, "orphan", 4, "?"), (1, None, 1, "x")], "conv_id long, call_id string, turn long, content string")
    rows = {(r.conv_id, r.call_id): r for r in chat.link_calls(calls, results, chat.TOOLS).collect()}
    assert rows[1, "a"].problems == [] and rows[1, "a"].level == 0
    assert rows[1, "a"].message == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"ok","turn":1}'
    assert rows[1, "b"].problems == ["limit isn't integer", "unexpected z", "result before call", "unknown dependency"] and rows[1, "b"].level == 1
    assert '"z":{"a":[2],"b":1}' in rows[1, "b"].message
    assert "cycle" in rows[1, "c"].problems and "cycle" in rows[1, "d"].problems and "unknown tool" in rows[1, "c"].problems
    assert rows[1, "orphan"].problems == ["no call"]
    order = [k for k, _ in sorted(((k[1], r.order_no) for k, r in rows.items() if k[0] == 1), key=lambda x: x[1])]
    assert order == ["a", "b", "orphan", "c", "d"]
    assert chat.link_calls(calls.limit(0), results.limit(0), chat.TOOLS).count() == 0


def test_adapter_of_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, None, "x"), (1, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1))
    got = sorted((str(r.conv_id), str(r.turn), str(r.call_id), r.problems) for r in chat.chat_report(turns).collect())
    assert got == [("1", "0", "call_1_0", "chars is missing; exact is missing"), ("2", "None", "None", "no turn"), ("3", "0", "None", "no role"), ("None", "0", "None", "no conversation")]


def test_long_chains_of_calls(spark, monkeypatch):
    # A chain of 300, a ladder (each call waits for the two before it), a cycle with a tail, and a call that waits for chain and ladder.
    deps = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(300)} | {f"l{k}": [f"l{j}" for j in (k - 1, k - 2) if j >= 0] for k in range(12)}
    deps |= {"x0": ["x2"], "x1": ["x0"], "x2": ["x1"], "tail": ["x1", "c5"], "both": ["c250", "l11"], "self": ["self"]}
    calls = spark.createDataFrame([(1, k) for k in deps] + [(2, "c0")], "conv_id long, call_id string")
    edges = spark.createDataFrame([(1, k, d) for k, ds in deps.items() for d in ds], "conv_id long, call_id string, dep string")
    rounds = []
    monkeypatch.setattr(chat, "durable", lambda df: rounds.append(1) or common.durable(df))
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(calls, edges).collect()}
    assert got == {(1, f"c{k}"): k for k in range(300)} | {(1, f"l{k}"): k for k in range(12)} | {(1, "both"): 251, (2, "c0"): 0}
    assert len(rounds) < 120  # six checkpoints a round; one round per link would be 1,800


def test_chat_keeps_whole_texts_and_all_turns(spark):
    odd = ["", 'say "x"\\ \n\t\x01 [1]', "да — 日本語 😀]", "</a> é [", "x" * 999 + "é", 'ends with "', "\u2028 line", "{}"]
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    rows += [(9000 + k, turn, role, t + "z" * pad) for k, t in enumerate(odd) for pad in range(3) for turn, role in ((10 * pad + 1, "user"), (10 * pad + 2, "assistant"))]
    rows += [(None, 0, "user", "a"), (9100, None, "assistant", "b"), (9100, 3, None, "c"), (9100, 4, "tool", None), (None, None, None, None)]
    got = chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    tools = {"search": "query", "lookup": "key"}
    asked = {(c, t): x for c, t, role, x in rows if role == "user" and c is not None}
    told = {(c, t - 1): x for c, t, role, x in rows if role == "assistant" and t is not None}
    left = [r for r in rows if r[0] is None or r[1] is None or r[2] not in ("user", "assistant")]
    assert len(got) == len(asked.keys() | told.keys()) + len(left)
    for key in asked.keys() | told.keys():
        row = next(r for r in got if r.call_id == f"call_{key[0]}_{key[1]}")
        message = json.loads(row.message)
        assert row.message == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert message.get("result") == told.get(key)
        if row.name in tools:
            assert message["arguments"][tools[row.name]] == asked[key]
    rest = sorted((str(r.conv_id), str(r.turn), r.problems, r.message) for r in got if r.call_id is None)
    assert len(rest) == len(left) and ("9100", "3", "no role", '{"content":"c","turn":3}') in rest and ("None", "0", "no conversation", '{"content":"a","role":"user","turn":0}') in rest
    assert {p for *_, p, _ in rest} == {"no conversation", "no turn", "no role", "neither call nor result: system", "neither call nor result: tool", "no conversation; no turn; no role"}


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, labels, bench, tmp_path, k):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns if k < 4 else {"shard", "slot", *docs.columns} <= set(out.columns)
    assert out.count() > 0
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), str(tmp_path)).count() == 0
