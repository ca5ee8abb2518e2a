"""Findings of round 3: what queries shuffle and write stays near their input, and shared rows are made once."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from cuelake.catalog import QUERIES
from cuelake.operators import passes

SF = "/root/testdata/sf0.01"


def moved(spark, run) -> int:
    """Bytes that run() shuffles, over all of its stages."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total() -> dict:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(found.apply, range(found.size()))}

    before = total()
    run()
    return sum(v for k, v in total().items() if k not in before)


@pytest.mark.parametrize("name, most", [("review_context", 2), ("verdict_check", 4), ("guide_files", 2)])
def test_texts_are_shuffled_about_once(spark, name, most):
    """In multiples of the documents: what is around a row doesn't travel, nor do a file's items by stem."""
    size = sum(map(os.path.getsize, glob.glob(f"{SF}/documents.parquet")))
    done = moved(spark, lambda: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert done < most * size, done / size


def test_neighbours_of_odd_rows(spark):
    from cuelake.plans.islands import neighbours

    lane = spark.createDataFrame([(1, p, f"t{p}") for p in (0, 1, 2, 5, 9)] + [(1, None, "lost"), (2, 4, "other"), (None, 3, "nobody's")], "file_id long, pos int, text string")
    rows = spark.createDataFrame([(1, 2, "a"), (1, 7, "b"), (1, 40, "c"), (2, 1, "d"), (3, 0, "e"), (1, None, "f")], "file_id long, row int, name string")
    near = {r["name"]: [x["text"] for x in r["window"]] for r in neighbours(rows, lane, "row", 3, "text").collect()}
    assert near == {"a": ["t0", "t1", "t2", "t5"], "b": ["t5", "t9"], "c": [], "d": ["other"], "e": []}
    assert {(r["target"], *r["context"]) for r in passes.context_windows(rows.select("file_id", F.col("row").alias("pos")), lane, 3).collect()} == {(2, "t0", "t1", "t2", "t5"), (7, "t5", "t9"), (1, "other")}


@pytest.mark.parametrize("name", ["tm_upsert", "tm_probe"])
def test_the_memory_is_made_once(spark, name):
    """What reads the memory again reads its rows, not the documents that it is made from."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "n_chars" not in plan


def test_the_cleaner_reads_each_file_in_passes(spark):
    """nothing around a row is looked up in a window that starts anew at every row, and texts are dealt out once."""
    plan = QUERIES["clean_files"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "1, unboundedfollowing$()" not in plan
    size = sum(map(os.path.getsize, glob.glob(f"{SF}/documents.parquet")))
    done = moved(spark, lambda: QUERIES["clean_files"](spark, SF).write.format("noop").mode("overwrite").save())
    assert done < 5.5 * size, done / size


def test_evidence_and_merging_of_odd_rows(spark):
    """islands end behind rows that can't take a next one, spans without evidence stay, equal spans bring all their texts."""
    from cuelake.operators import merge

    lane = spark.createDataFrame([(1, 0, 1, 0, 900, "一，"), (1, 1, 2, 950, 1500, "但 是。"), (1, 2, 3, 1600, 2000, "三"), (1, 3, 4, 2100, 2500, "——\n"), (1, 4, 5, 2600, 3000, None), (1, 5, 6, 70_000, 70_500, ""), (2, 0, 1, 0, 25_000, "long")], "file_id long, pos int, idx int, start_ms long, end_ms long, text string")
    merged = merge.merge_fragments(lane)
    assert {(r.file_id, r.pos): (r.text, r.members) for r in merged.collect()} == {(1, 0): ("一， 但 是。 三", 3), (1, 3): ("——\n ", 2), (1, 5): ("", 1), (2, 0): ("long", 1)}
    source = spark.createDataFrame([(1, 0, 900, "b"), (1, 0, 900, "a"), (1, 1600, 2000, "c"), (1, 1600, 1999, "not a row"), (2, 0, 25_000, None), (None, 0, 900, "nobody's")], "file_id long, start_ms long, end_ms long, text string")
    found = {(r.file_id, r.pos): r.evidence for r in merge.evidence(merged, lane, source).collect()}
    assert found == {(1, 0): ["a", "b", "c"], (1, 3): None, (1, 5): None, (2, 0): []}


def test_the_review_picks_its_rows_once(spark):
    """the rows of a review aren't compared again to find their final text, and texts of the passes don't travel."""
    plan = QUERIES["divergence_review"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1 and plan.count("max_by") == 3 and plan.count("posexplode") <= 6


def test_best_overlap_of_odd_rows(spark):
    lane = "file_id long, pos int, start_ms long, end_ms long, text string"
    left = spark.createDataFrame([(1, 0, 0, 25_000, "a"), (1, 1, 30_000, 30_000, "empty"), (1, 2, 40_000, 39_000, "backwards"), (1, 3, 90_000, 120_000, "alone"), (2, 0, 0, 1000, "b"), (1, 4, None, None, "c")], lane)
    right = spark.createDataFrame([(1, 0, 0, 2000, "x"), (1, 1, 19_000, 21_000, "y"), (1, 2, 24_000, 24_500, "z"), (2, 7, 999, 5000, "last"), (3, 0, 0, 1000, "other")], lane)
    found = {r.text: (r.r_pos, r.overlap_ms, r.r_text) for r in passes.best_overlap(left, right).collect()}
    none = (None, None, None)
    assert found == {"a": (0, 2000, "x"), "empty": none, "backwards": none, "alone": none, "b": (7, 1, "last"), "c": none}
    assert {(r.text, r.r_pos) for r in passes.best_spans(left, right).collect()} == {("a", 0), ("b", 7)}
