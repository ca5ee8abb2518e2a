"""What only larger tables show: keys that meet, and steps whose work grew faster than their input."""

from pyspark.sql import functions as F

from cuelake.sources import reports


def test_labels_of_films_that_share_an_index(spark):
    lines = spark.createDataFrame([("2500|film1|0.5|00:00:01,000|P1:a|P2:a",), ("2500|film2|0.5|00:00:01,000|P1:b|P2:b",)], "value string")
    labels = spark.createDataFrame([(2500, "film1", " A ")], "idx int, prefix string, label string")
    rows = {(r.idx, r.prefix, r.label) for r in reports.labelled_sample(lines, labels).collect()}
    assert rows == {(2500, "film1", "A"), (2500, "film2", "")}
    assert {r.label for r in reports.labelled_sample(lines, labels.drop("prefix")).collect()} == {"A"}


def test_needles_meet_their_own_group_only(spark, monkeypatch):
    """A word of every file is a needle of every file: pairs come from the file alone, and no gram of a text is laid out."""
    from cuelake.operators import validate
    from cuelake.plans import containment
    from cuelake.sources import sidecars

    monkeypatch.setattr(containment, "_grams", lambda *_: 1 / 0)
    final = spark.range(40).selectExpr("id % 20 AS file_id", "id AS pos", "id AS idx", "'the word' AS text", "concat('the word', id) AS orig_text")
    pairs = spark.range(20).selectExpr("id AS file_id", "'the' AS suspect", "'a' AS correct").union(spark.createDataFrame([(1, "word21", "x"), (2, "word21", "y"), (1, "", "z")]))
    rows = sorted((r.file_id, r.pos, r.suspect, r.correct) for r in sidecars.mishear_rows(final, pairs).collect())
    assert rows == sorted([(k % 20, k, "the", "a") for k in range(40)] + [(1, 21, "word21", "x")])
    texts = spark.range(300).selectExpr("0 AS file_id", "id AS pos", "concat('the word', id, ' end') AS source", "concat('der wort', id, ' ende') AS target")
    pairs = spark.range(300).selectExpr("0 AS file_id", "'the' AS src", "concat('wort', id) AS dst").union(spark.createDataFrame([(1, "the", "der"), (0, "word1", "wort299")]))
    for once in (1000, 7):
        found = containment.containing_in(texts, pairs, "file_id", lambda x: F.contains("source", x["src"]) & F.contains("target", x["dst"]), once).select("src", "dst").distinct()
        assert {tuple(r) for r in found.collect()} == {("the", f"wort{k}") for k in range(300)}
    known = spark.createDataFrame([], "src string")
    assert validate.verified_pairs(pairs, texts, known).count() == 300


def test_series_are_never_rows(spark):
    """Segments of a series equal those of its hops, over block borders too, and no shuffle or sort has its values."""
    import random

    from cuelake.operators import audio

    r = random.Random(1)
    files = [(k, [float(r.choice([0, 1, 1, 9, 9, 9, 12]) if k % 2 else r.random()) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 511, 512, 513, 1024, 5000])] + [(99, [1.0] * 700)]
    series = spark.createDataFrame(files, "file_id long, rms array<double>")
    hops = series.select("file_id", F.posexplode("rms").alias("hop_no", "rms"))
    old = audio.speech_segments(hops, audio.threshold(hops))
    new = audio.series_segments(series)
    assert sorted(map(tuple, new.drop("total_ms").collect())) == sorted(map(tuple, old.select("file_id", "start_ms", "end_ms").collect()))
    assert sorted(map(tuple, audio.series_ratio(new).collect())) == sorted(map(tuple, audio.speech_ratio(old, hops).collect()))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_cue_files_are_written_by_the_tasks(spark, tmp_path):
    """A file per file_id, whole and with no job of Spark's writer, whose commit moves every folder on the driver."""
    import pytest

    from cuelake.sources import cues as S

    cues = spark.range(60).selectExpr("id % 20 AS file_id", "cast(id AS int) AS pos", "id * 1000 AS start_ms", "id * 1000 + 500 AS end_ms", "concat('é', id) AS text")
    folder = tmp_path / "out"
    S.write_srt(cues, str(folder))
    found = {p.relative_to(folder).as_posix(): p.read_bytes().decode() for p in folder.rglob("*") if p.is_file()}
    assert found == {f"file_id={r.file_id}/cues.txt": r.content for r in S.format_srt(cues).collect()}
    assert not (folder / "_SUCCESS").exists()
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    assert [tuple(r) for r in S.scan_summary(S.list_files(spark, str(folder), "*.txt")).select("files", "folders").collect()] == [(20, 20)]
    assert spark.conf.get(name) == before
    with pytest.raises(FileExistsError):
        S.write_srt(cues, str(folder))


def test_decoding_in_slices(spark):
    from cuelake.sources import cues as S

    files = spark.range(150, numPartitions=1).selectExpr("id AS file_id", "CASE WHEN id % 7 > 0 THEN encode(concat('é', id), 'UTF-8') END AS content")
    rows = {r.file_id: (r.text, r.encoding, r.error) for r in S.decode(files).collect()}
    assert rows == {k: (f"é{k}", "utf-8", None) if k % 7 else (None, None, "no content") for k in range(150)}


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_purge_computes_its_candidates_once(spark):
    """However many steps read the candidates, their texts are normalised once, and the digest makes the plan once."""
    from cuelake.operators import memory
    from cuelake.plans.versions import settled

    tm = settled(memory.upsert(spark.createDataFrame([], memory.TM), spark.range(20).selectExpr("concat('Tëxt ', id) AS source_text", "'t' AS target_text", "1 AS stage", "timestamp'2024-01-01' AS created_at", "'f' AS source_name", "id AS ord")))
    rows = spark.range(0, 40, 2).selectExpr("concat('Tëxt ', id, if(id % 4 = 0, '!', '')) AS text", "if(id = 2, 'f', 'g') AS name")
    digest = memory.purge_digest(memory.purge_plan(tm, memory.purge_candidates(rows, rows.limit(0))))
    assert _optimized(digest).count("ArrowEvalPython") == 1
    assert sorted((r.match, r.rows, r.suspicious) for r in digest.collect()) == [("normalized", 5, 5), ("raw", 5, 4)]


def test_one_to_one_matching_is_a_stream_of_parts(spark):
    """Files aren't frames of their own: a task takes its files one after the other."""
    from cuelake.operators import compare

    a = spark.range(200).selectExpr("id % 50 AS file_id", "id AS pos", "id * 1000 AS start_ms", "id * 1000 + 900 AS end_ms", "'x' AS text")
    found = compare.side_by_side(a, a)
    assert "FlatMapGroupsInPandas" not in _optimized(found) and "MapInArrow" in _optimized(found)
    assert sorted(map(tuple, found.collect())) == sorted((k % 50, k, k, 900) for k in range(200))


def test_texts_of_a_pair_are_normalised_once(spark):
    from cuelake.operators import passes

    c = spark.range(40).selectExpr("id % 4 AS file_id", "id AS pos", "id * 1000 AS start_ms", "id * 1000 + 900 AS end_ms", "concat('a, b ', id) AS text")
    rows = passes.disagreement(c, c, c)
    assert _optimized(rows).count("translate(") == 2
    assert {(r.similarity, r.short) for r in rows.collect()} == {(1.0, 3), (1.0, 4)}


def test_listed_characters_are_those_of_the_patterns(spark):
    from cuelake.functions import text as T

    chars = spark.range(0x10000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS x")
    texts = chars.select(F.explode(F.array(F.concat("x", F.lit("a b"), "x", F.lit(" "), "x", F.lit("c"), "x"), F.col("x"), F.concat(F.lit("ä  "), "x"))).alias("t"))
    t, blank = F.col("t"), T.BLANK
    spaces = lambda c: F.trim(F.regexp_replace(c, f"{blank}+", " "))
    old = [spaces(t), F.regexp_replace(t, blank[:-1] + T.SIMILARITY_MARKS + "]+", ""), F.regexp_replace(t, blank, ""), F.regexp_replace(F.regexp_replace(t, f"^{blank}+", ""), f"{blank}+$", ""), spaces(F.regexp_replace(T._nfkc(t), r"[\p{P}…⋯‥~〜～·]", ""))]
    new = [T.norm_spaces(t), T.norm_similarity(t), T.compact(t), T.strip(t), T.norm_match(t)]
    for a, b in zip(old, new, strict=True):
        assert texts.filter(~a.eqNullSafe(b)).count() == 0


def test_ratio_of_texts_inside_others(spark):
    import random
    from difflib import SequenceMatcher

    from cuelake.functions import text as T

    r = random.Random(3)
    rows = []
    for n in (1, 5, 60, 199, 200, 450):
        for k in range(12):
            x = "".join(r.choice("ab c"[: 1 + k % 4]) for _ in range(n))
            i = r.randrange(n)
            rows += [(x, x), (x, x[i:] or "a"), (x[i:], x), (x, x[:i] + "z" + x[i:]), ("", x)]
    for f in spark.createDataFrame(rows, "a string, b string").select("a", "b", T.seq_ratio(F.col("a"), F.col("b")).alias("s")).collect():
        assert f.s == (SequenceMatcher(None, f.a, f.b).ratio() if f.a and f.b else 0.0)


def test_a_clock_is_searched_once(spark):
    from cuelake.sources import cues as S

    stamps = {"01:02:03.456": 3723456, " 2:3,4 ": 123400, "1:2:3.04": 3723040, "12:34": None, "1:2:3:4.5": None, "": None, "a|01:02.3": None}
    rows = spark.createDataFrame([(k,) for k in stamps], "c string").select("c", S._clock(F.col("c")).alias("ms"))
    assert {r.c: r.ms for r in rows.collect()} == stamps
    assert _optimized(rows).count("regexp_extract(") == 1
