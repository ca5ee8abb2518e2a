"""Findings of round 4."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [300, 4000])
def test_toxicity_learns_in_all_epochs_at_every_size(spark, monkeypatch, block):
    """rows that fill several blocks are gone through as often as those of one."""
    from cuelake.llm import toxicity

    docs = spark.range(1600).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 5 == 0, "nasty words here ").otherwise("kind words here "), F.col("id") % 50).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    seen, step = [], toxicity._next
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "_next", lambda blocks, *a: seen.append((blocks.count() > 1, a[-1])) or step(blocks, *a))
    toxicity.train(docs, labels)
    assert seen == [(block == 300, k) for k in range(6)]


def test_labelled_lines_of_large_indices(spark, tmp_path):
    """F2: an index beyond 32 bits is a number like any other; file ids from about 2.1 million on make such ones."""
    from cuelake.catalog import QUERIES
    from cuelake.sources import reports

    lines = spark.createDataFrame([("3000000007|film3000000|0.5|00:00:01,000|P1:a|P2:a",), ("7|film0|0.5|00:00:01,000|P1:b|P2:b",)], "value string")
    labels = spark.createDataFrame([(3000000007, " A ")], "idx long, label string")
    assert {(r.idx, r.label) for r in reports.labelled_sample(lines, labels).collect()} == {(3000000007, "A"), (7, "")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    rows = []
    for name, first in (("near", 0), ("far", 3_000_000)):
        docs.withColumn("doc_id", F.col("doc_id") + first).write.parquet(str(tmp_path / name / "documents.parquet"))
        found = QUERIES["labelled_sample"](spark, str(tmp_path / name)).collect()
        rows.append(sorted((r.idx - 1000 * first, int(r.prefix[4:]) - first, r.at_s // 3600, r.text1, r.label) for r in found))
    assert rows[0] and [(x[0], x[1], x[3], x[4]) for x in rows[0]] == [(x[0], x[1], x[3], x[4]) for x in rows[1]]


def _cue_rows(spark, files):
    return spark.range(2 * files).selectExpr(f"id % {files} AS file_id", "cast(id AS int) AS pos", "id * 1000 AS start_ms", "id * 1000 + 500 AS end_ms", "concat('é', id) AS text")


@pytest.mark.parametrize("spread", [0, 8])
def test_files_are_listed_by_the_tasks(spark, tmp_path, monkeypatch, spread):
    """the driver neither lists nor holds a file's name, in a listing or in a stream, which later sees new files only."""
    import os

    from cuelake.sources import cue_source
    from cuelake.sources import cues as S
    from cuelake.streaming import events as R

    folder = str(tmp_path / "in")
    S.write_srt(_cue_rows(spark, 40), folder, spread)
    os.makedirs(f"{folder}/_temporary/file_id=77")
    for odd in ("_temporary/file_id=77/cues.txt", ".hidden.txt", "_begun.txt", "note.md"):
        with open(f"{folder}/{odd}", "w") as f:
            f.write("x")
    assert len({x.path for x in cue_source.walked(folder, pattern="*.txt")}) == 40
    assert sorted(x.path for k in range(5) for x in cue_source.walked(folder, k, 5, "*.{txt,md}")) == sorted(x.path for x in cue_source.walked(folder, pattern="*.{txt,md}"))
    listed = S.list_files(spark, folder, "*.txt", least=1)
    assert listed.inputFiles() == [] and listed.rdd.getNumPartitions() == cue_source.shares_of(spark)
    old = {(r.path, r.length, r.modificationTime, bytes(r.content)) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder).collect()}
    assert {(r.path, r.length, r.modificationTime, bytes(r.content)) for r in listed.collect()} == old and len(old) == 40
    assert "ArrowEvalPython" not in S.scan_summary(listed)._jdf.queryExecution().executedPlan().toString()
    assert S.list_files(spark, folder, "*.txt", after="2000-01-01T00:00:00", before="2100-01-01T00:00:00", exclude=("c?es*",)).count() == 0
    assert S.list_files(spark, folder, "*.txt", after="2100-01-01T00:00:00").count() == 0
    out = str(tmp_path / "out")
    first = R.drained(R.arriving_files(spark, folder, "*.txt"), out)
    assert {(r.path, r.content) for r in first.collect()} == {(p.removeprefix("file:"), c.decode()) for p, _, _, c in old}
    S.write_srt(_cue_rows(spark, 3), f"{folder}/more")
    later = R.drained(R.arriving_files(spark, folder, "*.txt"), out)
    assert later.count() == 43 and later.filter("path like '%/more/%'").count() == 3
    held = [p for _, _, names in os.walk(f"{out}/state") for p in names]
    assert not any("cues.txt" in open(os.path.join(at, p), errors="ignore").read() for at, _, names in os.walk(f"{out}/state") for p in names) and held


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_first_texts_containing_few_needles(spark, monkeypatch, piece):
    """no gram is laid out, neither as a row nor in an exchange, and the least ids are those of all pairs."""
    import random

    from cuelake.plans import containment

    monkeypatch.setattr(containment, "PIECE", piece)
    r = random.Random(4)
    texts = [(k, "".join(r.choice("abcあい\0😀 ") for _ in range(r.randint(0, 30)))) for k in r.sample(range(1000), 400)] + [(2000, None), (None, "abc"), (-5, "z"), (2001, "")]
    needles = [(k, "".join(r.choice("abcあい\0😀 ") for _ in range(r.randint(0, 5)))) for k in range(200)] + [(300, "x" * 50), (301, "z"), (302, None), (303, "a"), (303, "b")]
    t, n = spark.createDataFrame(texts, "id long, s string").repartition(3), spark.createDataFrame(needles, "key int, t string")
    want = {}
    for i, s in texts:
        for key, x in needles:
            if x and s and i is not None and x in s:
                want[key] = min(i, want.get(key, i))
    found = containment.first_containing(t, n, "key")
    assert {x.key: x.id for x in found.collect()} == want and found.schema["key"] == n.schema["key"]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert containment.first_containing(t, n.limit(0), "key").count() == 0 and containment.first_containing(t.limit(0), n, "key").count() == 0


def test_a_probe_is_the_same_with_few_and_many_queries(spark, monkeypatch):
    """whether queries are sent to the tasks or shuffled, and no step lays out the memory's grams."""
    from cuelake.catalog import QUERIES
    from cuelake.plans import containment

    rows = lambda: sorted(map(tuple, QUERIES["tm_probe"](spark, SF).collect()))
    grid = containment._grams
    monkeypatch.setattr(containment, "_grams", lambda *_: 1 / 0)
    few = rows()
    monkeypatch.setattr(containment, "_grams", grid)
    monkeypatch.setattr(containment, "FEW", 0)
    assert few and few == rows() and {x[1] for x in few} == {"exact", "normalised", "like"}


def test_a_review_table_deals_its_files_out_once(spark):
    """what is shuffled is the documents, once, and the rows that are written; settings are as before."""
    import glob
    import os

    from cuelake.catalog import QUERIES

    name, sc, sf = "spark.sql.requireAllClusterKeysForCoPartition", spark.sparkContext, SF.replace("0.001", "0.01")
    before = spark.conf.get(name)
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(found.apply, range(found.size()))}

    old = stages()
    found = QUERIES["review_table"](spark, sf).count()
    done = sum(v for k, v in stages().items() if k not in old)
    assert found and done < 2.5 * sum(map(os.path.getsize, glob.glob(f"{sf}/documents.parquet"))) and spark.conf.get(name) == before
