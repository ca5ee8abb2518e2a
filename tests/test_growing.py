"""The index that grows by segments, the memory's versions, and the stateful streams."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuelake.operators import memory, search, snapshots
from cuelake.plans import versions as V
from cuelake.plans.containment import containing
from cuelake.streaming import sessions

# -- full-text index ----------------------------------------------------------------------------------

TEXTS = "id long, text string"


def words(k, common=True):
    r = random.Random(k)
    out = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randint(1, 14))]
    return " ".join((["the"] * r.randint(1, 3) if common else []) + out)


def plain_search(docs, queries, limit):
    held = {k: Counter(re.findall(r"[a-z0-9]+", (t or "").lower())) for k, t in docs.items()}
    size = {k: sum(c.values()) for k, c in held.items()}
    mean = sum(size.values()) / max(1, sum(n > 0 for n in size.values()))
    df = Counter(t for c in held.values() for t in c)
    out = []
    for q, text in queries:
        asked = set(re.findall(r"[a-z0-9]+", text.lower()))
        hits = []
        for k, c in held.items():
            if asked and all(t in c for t in asked):
                s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[k] / mean)) for t in asked)
                hits.append((-round(s, 9), k))
        out += [(q, k, pytest.approx(-s, abs=2e-6), rank) for rank, (s, k) in enumerate(sorted(hits)[:limit], 1)]
    return sorted(out, key=lambda r: (r[0], r[3]))


QUERIES = [("one", "the"), ("two", "the w1"), ("three", "w1 w2 w3"), ("rare", "w251 the"), ("none", "absent the"), ("empty", "..."), ("twice", "W1 w1, w1!")]


def found(spark, root, limit=5, **options):
    q = spark.createDataFrame(QUERIES, "query_id string, text string")
    return sorted((tuple(r) for r in search.search(q, root, limit, **options).select("query_id", "id", "score", "rank").collect()), key=lambda r: (r[0], r[3]))


def test_search_appends_replaces_and_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "FIRST_BLOCKS", 1)
    root = str(tmp_path / "index")
    search.create(spark, root)
    assert found(spark, root) == []
    docs = {k: words(k) for k in range(400)} | {400: None, 401: "", 402: "?!"}
    search.append(spark.createDataFrame(list(docs.items()), TEXTS), root, block_docs=32)
    assert found(spark, root) == plain_search(docs, QUERIES, 5)
    first = sorted(p.name for p in (tmp_path / "index/postings").iterdir())
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    more = {k: words(k, common=k % 2 == 0) for k in range(500, 600)}
    changed = {k: words(k + 9000) for k in range(0, 400, 7)}
    batch = more | changed | {1: docs[1], 3: docs[3]}  # two that are held as they are
    assert search.append(spark.createDataFrame(list(batch.items()), TEXTS), root, block_docs=32) == 2
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items()) and len(first) == 1
    assert spark.read.parquet(f"{root}/forward").filter(~F.col("seg").startswith("s1-")).count() == len(more) + len(changed)
    now = docs | more | changed
    assert found(spark, root) == plain_search(now, QUERIES, 5)
    assert found(spark, root, version=1) == plain_search(docs, QUERIES, 5)
    assert found(spark, root, limit=0) == plain_search(now, QUERIES, 1) and found(spark, root, limit=999) == plain_search(now, QUERIES, 200)
    search.compact(spark, root, f"{root}-2", block_docs=32)
    assert found(spark, f"{root}-2") == plain_search(now, QUERIES, 5)
    # A segment that wasn't committed isn't read.
    spark.read.parquet(f"{root}/postings").filter(F.col("seg").startswith("s1-")).withColumn("seg", F.lit("s9-lost")).write.mode("append").partitionBy("seg", "bucket").parquet(f"{root}/postings")
    assert found(spark, root) == plain_search(now, QUERIES, 5)


def test_a_word_in_every_document_stays_in_blocks(spark, tmp_path):
    sizes = {}
    for common in (False, True):
        root = str(tmp_path / f"index{common}")
        search.create(spark, root)
        search.append(spark.createDataFrame([(k, words(k, common)) for k in range(3000)], TEXTS), root, block_docs=100)
        rows = spark.read.parquet(f"{root}/postings")
        sizes[common] = rows.agg(F.max("n")).first()[0]
        assert rows.filter("term = 'the'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] == (3000 if common else 0)
    assert sizes[True] < 160  # hashing deals 100 to a block, about
    assert found(spark, root, 20) == plain_search({k: words(k) for k in range(3000)}, QUERIES, 20)


# -- versions of the memory ---------------------------------------------------------------------------

PAIRS = "source_text string, target_text string, stage int, created_at timestamp, source_name string, ord long"


def pairs(*rows):
    return [(s, t, 1, datetime(2024, 1, 1), name, k) for k, (s, t, name) in enumerate(rows)]


def content(spark, root, version=None):
    return {r["source_text"]: (r["id"], r["target_text"], r["source_name"]) for r in snapshots.read(spark, root, version).collect()}


def test_memory_versions(spark, tmp_path):
    root = str(tmp_path / "tm")
    start = memory.upsert(spark.createDataFrame([], memory.TM), spark.createDataFrame(pairs(("a", "A", "f"), ("b", "B", "f")), PAIRS))
    snapshots.create(start, root)
    zero = content(spark, root)
    first = spark.createDataFrame(pairs(("b", "B2", None), ("c", "C", "g"), ("c", "C2", None)), PAIRS)
    assert snapshots.upsert_batch(root, first, "w", 0) == 1
    one = content(spark, root)
    assert one["a"] == zero["a"] and one["b"] == (zero["b"][0], "B2", "f") and one["c"] == (3, "C2", "g")
    # The same batch again, also with other rows, and another writer's batch of the same number.
    assert snapshots.upsert_batch(root, spark.createDataFrame(pairs(("d", "D", None)), PAIRS), "w", 0) == 1 and content(spark, root) == one
    assert snapshots.upsert_batch(root, spark.createDataFrame(pairs(("a", "A2", None), ("d", "D", None)), PAIRS), "v", 0) == 2
    two = content(spark, root)
    assert two["a"][1] == "A2" and two["d"][0] == 4 and content(spark, root, 0) == zero and content(spark, root, 1) == one
    assert snapshots.compact(spark, root) == 3 and content(spark, root) == two
    assert snapshots.upsert_batch(root, spark.createDataFrame(pairs(("e", "E", None)), PAIRS), "w", 1) == 4 and content(spark, root)["e"][0] == 5
    assert len(snapshots.expire(spark, root, 3)) == 3 and content(spark, root, 3) == two
    assert snapshots.upsert_batch(root, first, "w", 0) == 1


def test_a_batch_stopped_before_its_commit(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tm")
    snapshots.create(spark.createDataFrame([], memory.TM), root)
    batch = spark.createDataFrame(pairs(("a", "A", "f")), PAIRS)
    with monkeypatch.context() as m:
        m.setattr(V, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            snapshots.upsert_batch(root, batch, "w", 0)
    assert len(list((tmp_path / "tm/data").iterdir())) == 2 and content(spark, root) == {}
    assert snapshots.upsert_batch(root, batch, "w", 0) == 1 and content(spark, root)["a"][0] == 1


def test_streamed_batches_equal_one_after_the_other(spark, tmp_path):
    rows = [(f"s{k % 17}", f"t{k}", 1, datetime(2024, 1, 1), None, k) for k in range(60)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    snapshots.create(spark.createDataFrame([], memory.TM), str(tmp_path / "tm"))
    want = spark.createDataFrame([], memory.TM)
    for k in range(3):
        batch = spark.createDataFrame(rows[20 * k : 20 * k + 20], PAIRS)
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        want = spark.createDataFrame(memory.upsert(want, batch).collect(), memory.TM)
        snapshots.learn(stream, str(tmp_path / "tm"), "w", str(tmp_path / "state")).awaitTermination()
    assert sorted(map(str, snapshots.read(spark, str(tmp_path / "tm")).collect())) == sorted(map(str, want.collect()))
    assert [r["batch"] for r in V.history(spark, str(tmp_path / "tm"))] == [-1, 0, 1, 2]


# -- sessions with timers -----------------------------------------------------------------------------

EVENTS = "task_id string, ts timestamp, seq long, type string, phase string, file string, message string"
START = datetime(2024, 1, 1)


def events(n=300):
    r = random.Random(3)
    rows = [(f"t{r.randint(0, 5)}", START + timedelta(seconds=r.randint(0, 4000), microseconds=r.randint(0, 999999)), k, r.choice(["error", "log"]), "p", None if k % 3 else "f", f"m{r.randint(0, 2)}") for k in range(n)]
    return rows + [("t1", START + timedelta(seconds=4001), n, sessions.ENDS, "p", None, "end")]


#: An event so late that the watermark passes all others.
FLUSH = ("flush", START + timedelta(days=40), 10**6, "log", "p", None, "flush")


def run_stream(spark, tmp_path, rows, make, batches=5):
    """Shuffled rows as files, one per micro-batch; the flush comes last, and then one more that is dropped or new."""
    random.Random(1).shuffle(rows)
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with sessions.timed_state(spark):
        for _ in range(2):
            query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
            spark.createDataFrame([FLUSH], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "out")), query


def runs_of(rows, key, gap):
    out = []
    groups = defaultdict(list)
    for r in rows:
        groups[key(r)].append(r)
    for k, own in groups.items():
        run = []
        for r in sorted(own, key=lambda r: (r[1], r[2])):
            if run and r[1] - run[-1][1] > gap:
                out.append((k, run))
                run = []
            run.append(r)
        out.append((k, run))
    return out


def test_capped_risks_equal_a_fold(spark, tmp_path):
    rows = [r for r in events() if r[3] == "error"]
    out, query = run_stream(spark, tmp_path, list(rows), lambda s: sessions.capped_risks(s.filter("type = 'error' or task_id = 'flush'"), 2, "400 seconds", "1 day"))
    got = sorted(str((tuple(r[c] for c in sessions.RISK), r["ts"], r["seq"], r["nth"], r["seen"], r["suppressed"])) for r in out.collect())
    want = []
    for key, run in runs_of(rows, lambda r: (r[0], r[3], r[4], r[5], r[6]), timedelta(seconds=400)):
        want += [str((key, r[1], r[2], k, len(run), max(0, len(run) - 2))) for k, r in enumerate(run[:2], 1)]
    assert got == sorted(want) and any(", 0)" not in w for w in want)
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 2  # what is left is the flush's


def test_stall_alarms_equal_a_fold(spark, tmp_path):
    rows = events(120)
    out, _ = run_stream(spark, tmp_path, list(rows), lambda s: sessions.stall_alarms(s, "200 seconds", "1 day"))
    gap, want = timedelta(seconds=200), []
    last = {}
    for key, run in runs_of(rows, lambda r: r[0], gap):
        if key in last:
            want.append((key, "resumed", run[0][1]))
        if run[-1][3] != sessions.ENDS:
            last[key] = run[-1][1] + gap
            want.append((key, "stalled", last[key]))
    assert sorted(map(tuple, out.filter("task_id <> 'flush'").collect())) == sorted(want)


def test_an_alarm_before_the_task_speaks_again(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    event = lambda task, s: (task, at(s), s, "log", "p", None, "m")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    with sessions.timed_state(spark):
        for batch in ([event("silent", 0), event("busy", 0)], [event("busy", 30)], [event("busy", 60)], [event("silent", 100), event("busy", 90)], [event("busy", 130)]):
            spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            sessions.stall_alarms(stream, "45 seconds", "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
            seen.append(sorted((r["state"], r["at"]) for r in spark.read.schema("task_id string, state string, at timestamp").parquet(str(tmp_path / "out")).filter("task_id = 'silent'").collect()))
    assert seen == [[], [], [("stalled", at(45))], [("stalled", at(45))], [("resumed", at(100)), ("stalled", at(45))]]


def test_an_alarm_while_nobody_speaks(spark, tmp_path):
    spark.createDataFrame([("a", START, 1, "log", "p", None, "m"), ("b", START, 1, sessions.ENDS, "p", None, "m")], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    read = lambda: [tuple(r) for r in spark.read.schema("task_id string, state string").parquet(str(tmp_path / "out")).collect()]
    with sessions.timed_state(spark):
        query = sessions.silence_alarms(stream, "2 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
        try:
            until = time.time() + 60
            while time.time() < until and not ((tmp_path / "out").exists() and read()):
                time.sleep(0.5)
            assert read() == [("a", "stalled")]
            spark.createDataFrame([("a", START, 2, "log", "p", None, "m")], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            while time.time() < until and len(read()) < 2:
                time.sleep(0.5)
            assert sorted(read())[:2] == [("a", "resumed"), ("a", "stalled")]
        finally:
            query.stop()


# -- containment --------------------------------------------------------------------------------------

def test_texts_containing_needles(spark):
    r = random.Random(4)
    texts = [(k, "".join(r.choice("abcあいう ") for _ in range(r.randint(0, 30)))) for k in range(400)] + [(900, None), (901, ""), (902, "aaaa")]
    needles = [(f"n{k}", "".join(r.choice("abcあいう ") for _ in range(r.randint(0, 4)))) for k in range(150)] + [("same", "ab"), ("same", "ab"), ("long", "x" * 50), ("all", "a")]
    t, n = spark.createDataFrame(texts, "id long, s string"), spark.createDataFrame(needles, "key string, t string").distinct()
    want = sorted({(k, key, x) for k, s in texts for key, x in needles if x and s and x in s})
    for once in ({}, {"needles_at_once": 2, "texts_at_once": 7}):
        assert sorted(map(tuple, containing(t, n, ["id"], "key", **once).collect())) == want
    assert containing(t, n.limit(0), ["id"], "key").count() == 0 and containing(t.limit(0), n, ["id"], "key").count() == 0


def test_terms_that_begin_alike_do_not_meet(spark):
    """10,000 terms with one beginning over texts that have one of them each: candidates are near the true pairs."""
    terms = spark.range(10_000).select(F.col("id").alias("key"), F.concat(F.lit("prefix-"), F.lpad(F.conv((F.col("id") * 7919 % 10_000 + 100_000).cast("string"), 10, 36), 4, "0")).alias("t"))
    texts = terms.filter("key % 10 = 0").select(F.col("key").alias("id"), F.concat(F.lit("a "), "t", F.lit(" z")).alias("s"))
    tried = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(s, t):
        tried.add(1)
        return t in s

    found = containing(texts, terms, ["id"], "key", counted(F.col("s"), F.col("t"))).collect()
    assert sorted((r.id, r.key) for r in found) == [(k, k) for k in range(0, 10_000, 10)] and tried.value < 100_000


# -- cue files as a data source -----------------------------------------------------------------------

def test_cue_files_in_batch_and_stream(spark, tmp_path):
    from cuelake.sources import cue_source
    from cuelake.streaming import events as R

    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    one = lambda k: f"1\n00:00:0{k},000 --> 00:00:0{k},500\nrow {k}\n"
    for k in range(5):
        (folder / ("deep" if k % 2 else ".") / f"f{k}.srt").write_text(one(k), encoding="utf-8")
    (folder / "legacy.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n日本語\n".encode("cp932"))
    (folder / "page.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nvtt\n", encoding="utf-8")
    (folder / "note.txt").write_text("x", encoding="utf-8")
    (folder / "_unfinished.srt").write_text(one(9), encoding="utf-8")
    batch = cue_source.cue_files(spark, str(folder), splitBytes=100)
    assert 1 < batch.rdd.getNumPartitions() < 8
    cues, rejects = cue_source.parsed(batch)
    assert sorted(r.text for r in cues.collect()) == sorted([f"row {k}" for k in range(5)] + ["日本語", "vtt"])
    found = {r.file_id.rsplit("/", 1)[-1]: r.warning for r in rejects.collect()}
    assert found == {"note.txt": "unknown format"}
    # A file that went between listing and reading is a row with an error.
    (gone,) = cue_source.CueFiles({"path": str(folder)}).reader(None).read(cue_source._Part([(0, f"{folder}/gone.srt", 3)]))
    assert gone[1] == "gone.srt" and gone[4] is None and "FileNotFoundError" in gone[5]
    broken = spark.createDataFrame([(gone[0], gone[1], gone[2], gone[3], gone[4], gone[5])], cue_source.CueFiles({}).schema())
    assert [r.warning for r in cue_source.parsed(broken)[1].collect()] == [gone[5]]
    stream = cue_source.cue_files(spark, str(folder), stream=True)
    first = R.drained(stream, str(tmp_path / "out")).select("name", "content")
    assert sorted(map(str, first.collect())) == sorted(map(str, batch.select("name", "content").collect()))
    (folder / "late.srt").write_text(one(7), encoding="utf-8")
    again = R.drained(cue_source.cue_files(spark, str(folder), stream=True), str(tmp_path / "out"))
    assert batch.count() == 8 and again.count() == 9 and again.filter("name = 'late.srt'").count() == 1
    only = cue_source.cue_files(spark, str(folder), pattern="f?.srt")
    assert only.count() == 5 and cue_source.cue_files(spark, str(tmp_path / "none")).count() == 0
