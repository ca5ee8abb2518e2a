"""Branches that the given tables don't reach, on small typed rows."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.timecode import format_ms, parse_timing
from cuelake.operators import assemble, clean, compare, gate, glossary, memory, merge, passes, quality, review, search, validate
from cuelake.sources import cues as S
from cuelake.sources import sidecars


#: Words of a made-up project.
GATE = gate.GateRules(keep=("はい",), isolated=("うんうん", "はい"), meta=("登録お願い",), meta_latin=("see you",))
CLEAN = clean.CleanRules(short=("好",), exclamations=("哇",), actions=("去",), meta_strong=("订阅",), degrees=("太",), hardened=("老师",), hardened_patterns=("第[0-9]集",))


def cues(spark, rows, file_id=1):
    """rows: (start_ms, end_ms, text)"""
    return spark.createDataFrame([(file_id, k, k + 1, a, b, t) for k, (a, b, t) in enumerate(rows)], "file_id long, pos int, idx int, start_ms long, end_ms long, text string")


def spaced(spark, texts, step=2000):
    return cues(spark, [(k * step, k * step + 1000, t) for k, t in enumerate(texts)])


@pytest.mark.parametrize(("text", "category"), [
    ("！！！", "exclamation"), ("!!", "exclamation"), ("。。。", "pure_punctuation"), ("sssss", "unpronounceable"), ("TV", None), ("kk", "unpronounceable"), ("hello", None),
    ("はい", None), ("うんうん", "isolated_response"), ("あじゃあじゃあじゃあじゃ", "nonsense_syllables"), ("んああああああ", "nonsense_syllables"), ("あああああああ", None), ("行きましょう", None),
])
def test_gate_classes(spark, text, category):
    rows = gate.classify(spaced(spark, ["話です", text, "次の話", "それから", "終わり"]), GATE)
    assert rows.filter("pos = 1").first()["category"] == category


def test_gate_repeats_valve_and_meta(spark):
    texts = ["みんな"] * 4 + [f"話{k}です" for k in range(8)] + ["登録お願いします"]
    rows = {r.pos: r for r in gate.classify(spaced(spark, texts), GATE).collect()}
    assert [rows[k].category for k in range(4)] == ["repeat_loop"] * 4
    assert rows[12].category == "end_meta" and rows[12].deleted and not rows[12].valve_tripped
    tripped = gate.classify(spaced(spark, ["みんな"] * 4 + ["話です", "次です"])).collect()
    assert all(r.valve_tripped and not r.deleted for r in tripped)
    three = ["話です"] * 3 + [f"別{k}です" for k in range(7)]
    assert gate.classify(spaced(spark, three)).filter("category is not null").count() == 0
    assert gate.classify(spaced(spark, three), low_trust=F.col("pos") == 1).filter("category = 'repeat_loop'").count() == 3


def test_premerge(spark):
    def merged(*rows):
        return [r.text for r in merge.premerge(cues(spark, rows)).orderBy("pos").collect()]

    assert merged((0, 1000, "今日は"), (1500, 2000, "学校に"), (2600, 3000, "行きます")) == ["今日は学校に行きます"]
    assert merged((0, 1000, "今日は"), (2100, 2500, "休み")) == ["今日は", "休み"]
    assert merged((0, 1000, "行きます"), (1300, 1500, "帰ります")) == ["行きます", "帰ります"]
    assert merged((0, 1000, "部長で…"), (1100, 1500, "誰もが見る人です")) == ["部長で…", "誰もが見る人です"]
    assert merged((0, 3000, "今日は"), (3100, 5001, "学校に")) == ["今日は", "学校に"]
    assert merged((0, 1000, "a"), (1100, 1200, "b"), (1250, 1300, "c"), (1350, 1400, "d")) == ["abc", "d"]


def test_merge_fragments(spark):
    rows = [(0, 1000, "我，"), (1200, 2000, "去"), (2100, 3000, "好"), (3100, 3500, "但是"), (3600, 4000, "来")]
    out = merge.merge_fragments(cues(spark, rows)).orderBy("pos").collect()
    assert [(r.text, r.members) for r in out] == [("我， 去", 2), ("好", 1), ("但是 来", 2)]


def test_cleaner_needs_evidence(spark):
    rows = cues(spark, [(0, 1000, "哇"), (20_000, 21_000, "哇"), (40_000, 41_000, "订阅"), (60_000, 61_000, "我们去吧"), (62_000, 62_500, "嗯"), (90_000, 91_000, "好")])
    evidence = {0: ["ああ"], 1: ["漢字"], 2: ["あ"], 3: ["いこう"], 4: ["うん"], 5: ["ああああああ"]}
    table = spark.createDataFrame([(k, v) for k, v in evidence.items()], "pos int, evidence array<string>")
    found = {r.pos: (r.rule, r.deleted) for r in clean.judged(rows.join(table, "pos"), CLEAN).collect()}
    assert found[0] == ("L6-pure-exclamation", True)
    assert found[1] == ("kept-by-source-evidence", False)
    assert found[2] == ("L3-meta", True)
    assert found[4] == ("L2-segment-content", False)
    assert found[5] == ("L8-short-response", True)


def test_alignment_consumes_in_order(spark):
    left = cues(spark, [(0, 1000, "a"), (0, 1000, "b"), (5000, 9000, "merged"), (5000, 6000, "x")])
    right = cues(spark, [(0, 1000, "A"), (0, 1000, "B"), (5000, 6000, "X"), (7000, 8000, "Y")])
    found = [r.orig_text for r in passes.align_by_start(left, right).orderBy("pos").collect()]
    assert found == ["A", "B", "X", "X"]


def test_best_overlap_ties_go_to_the_first(spark):
    left = cues(spark, [(0, 1000, "a"), (100_000, 130_000, "long")])
    right = cues(spark, [(0, 500, "p"), (500, 1000, "q"), (95_000, 101_000, "r"), (102_000, 129_000, "s")])
    found = [(r.r_text, r.overlap_ms) for r in passes.best_overlap(left, right).orderBy("pos").collect()]
    assert found == [("p", 500), ("s", 27_000)]


def test_times(spark):
    row = spark.createDataFrame([("01:02:03,004 --> 01:02:04,5",), ("nonsense",)], "t string").select(parse_timing(F.col("t")).alias("a"), parse_timing(F.col("t"), pad_ms=True).alias("b")).collect()
    assert (row[0].a.start_ms, row[0].a.end_ms, row[0].b.end_ms) == (3_723_004, 3_724_005, 3_724_500)
    assert row[1].a is None
    assert spark.range(1).select(format_ms(F.lit(3_723_004)).alias("x")).first().x == "01:02:03,004"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.strip(F.lit("　 a "))) == "a"
    assert one(T.norm_words(F.lit("あ、b_c!"))) == "あbc"
    assert one(T.weighted_length(F.lit("ab漢"))) == 2.0
    assert one(T.normalize_untranslated(F.lit("[未翻译] Chicks."), F.lit("ひよこ"))) == "[未翻译] ひよこ"
    assert one(T.normalize_untranslated(F.lit("[未翻译] Chicks."), F.lit(None))) == "[未翻译]"
    assert one(T.contains_term(F.lit("cat"), F.lit("category"))) is False
    assert one(T.contains_term(F.lit("cat"), F.lit("my CAT!"))) is True
    assert one(T.contains_term(F.lit("猫"), F.lit("黒猫です"))) is True
    assert one(T.contains_term(F.lit("ＣＡＴ"), F.lit("my cat!"))) is True
    assert one(T.nfkc(F.lit("ＡＢ①"))) == "AB1"
    assert one(T.norm_similarity(F.lit("a：b；c'd\"e／f《g》-・"))) == "abcdefg-・"
    assert one(T.norm_match(F.lit("「ＡＢ」　 c〜…"))) == "AB c"
    assert one(T.first_json(F.lit("x [1, 2] y"))) == "[1, 2]" and one(T.first_json(F.lit("x [1, 2 y]"))) is None
    assert one(T.evidence_times(F.lit("at 0:00:01,500 and 1:00:00.0"))) == [1500, 3_600_000]
    assert one(T.peel_quotes(F.lit(' "x" '))) == "x"
    assert [tuple(p) for p in one(T.csv_pairs(F.lit("a,b\nbad\nc\td")))] == [("a", "b"), ("c", "d")]


def test_srt_parsers(spark):
    text = "1\r\n00:00:01,000 --> 00:00:02,000\r\nhello\r\nthere\r\n\r\nno index\r\n\r\n3\r\n00:00:03,000 --> 00:00:04,000\r\nbye\r\n"
    files = spark.createDataFrame([(1, text)], "file_id long, content string")
    assert [(r.idx, r.text) for r in S.parse_srt(files).orderBy("pos").collect()] == [(1, "hello\nthere"), (3, "bye")]
    assert [(r.idx, r.start_ms, r.text) for r in S.parse_srt(files, strict=False).orderBy("pos").collect()] == [(1, 1000, "hello\nthere"), (2, 0, "no index"), (3, 3000, "bye")]
    noise = spark.createDataFrame([(1, "5\n\n6\n00:00:01,000 --> 00:00:02,000\n\n7\ntext")], "file_id long, content string")
    assert [(r.idx, r.end_ms, r.text) for r in S.parse_srt(noise, strict=False).orderBy("pos").collect()] == [(6, 2000, ""), (7, 0, "text")]


def test_vtt_and_ass(spark):
    vtt = "WEBVTT\n\nNOTE x\n\nid1\n00:01.000 --> 00:02.500 align:start\n<v Ann>Hi <c.red>you</c>\n\n00:02.000 --> 00:03.000\n<i></i>\n"
    good, bad = S.converted(S.parse_vtt(spark.createDataFrame([(1, vtt)], "file_id long, content string")))
    assert [(r.start_ms, r.end_ms, r.text, r.tags) for r in good.collect()] == [(1000, 2500, "Hi you", 3)]
    assert [r.line for r in bad.collect()] == [9]
    ass = "[Events]\nFormat: Marked, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.00,a, b\nDialogue: broken\n"
    rows = S.parse_ass(spark.createDataFrame([(1, ass)], "file_id long, content string")).orderBy("line").collect()
    assert [(r.line, r.start_ms, r.text) for r in rows] == [(3, 1000, "a, b"), (4, None, "broken")]


def test_decode_ladder(spark):
    blobs = ["あい".encode(), b"\xef\xbb\xbfab", "あい".encode("cp932"), b"a\x81", None]
    files = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate(blobs)], "file_id int, content binary")
    rows = {r.file_id: r for r in S.decode(files).collect()}
    assert [rows[k].encoding for k in range(5)] == ["utf-8", "utf-8-sig", "cp932", None, None]
    assert rows[2].text == "あい" and rows[3].error == "no encoding fits"


def test_wav_hops(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(np.repeat([0, 100], 20).astype("<i2").tobytes())
    rows = S.read_wav(spark.createDataFrame([(1, bytearray(out.getvalue()))], "file_id long, content binary")).orderBy("hop_no").collect()
    assert [r.rms for r in rows] == [0, 0, 100, 100]


def test_upsert_is_sequential(spark):
    tm = spark.createDataFrame([(7, T_hash("s"), "s", "old", 1, 1, 3, None, "f", "ja", "zh")], memory.TM).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    batch = spark.createDataFrame([("s", "x", 1, "2025-01-01", None, 1), (" s ", "y  z", 1, "2025-01-02", None, 2), ("t", "z", 1, "2025-01-03", "g", 3), ("t", "w", 1, "2025-01-04", None, 4), ("t", "v", 2, "2025-01-05", None, 5), (" ", "empty", 1, "2025-01-06", None, 6)], "source_text string, target_text string, stage int, created_at string, source_name string, ord long").withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = memory.upsert(tm, batch)
    rows = {(r.source_text, r.stage): r for r in out.collect()}
    assert set(out.columns) == {c.split()[0] for c in memory.TM.split(", ")} and len(rows) == 3
    old, new = rows["s", 1], rows["t", 1]
    assert (old.id, old.target_text, old.hit_count, str(old.created_at)[:10], old.source_name, old.char_count) == (7, "y z", 3, "2024-01-01", "f", 1)
    assert (new.target_text, new.hit_count, str(new.created_at)[:10], new.source_name, new.source_lang) == ("w", 0, "2025-01-03", "g", "ja")
    assert sorted(r.id for r in rows.values()) == [7, 8, 9]
    # What was stored is found again, by stage and direction.
    asked = spark.createDataFrame([("t", 1), ("t", 3)], "text string, stage int")
    assert sorted((r.stage, r.target_text) for r in memory.lookup_exact(asked, out).collect() if r.id) == [(1, "w")]
    assert memory.lookup_exact(asked.withColumn("target_lang", F.lit("en")), out).filter("id is not null").count() == 0
    assert [dict(r.targets) for r in memory.lookup_stages(asked.limit(1), out).collect()] == [{1: "w", 2: "v"}]
    assert memory.known(asked, out).count() == 1


def T_hash(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:32]


def entries(spark, rows):
    """rows: (id, source, created or None, name)"""
    out = spark.createDataFrame([(k, T_hash(s), s, "t", 1, len(s), 0, None, name, "ja", "zh", at) for k, s, at, name in rows], memory.TM + ", at string")
    return out.withColumn("created_at", F.col("at").cast("timestamp")).drop("at")


def test_purge_plan(spark):
    tm = entries(spark, [(1, "学校に行く", "2024-01-05", "film"), (2, "学校に行く。", None, None), (3, "「学校」に行く！", "2024-03-01", "other"), (4, "今日は学校", "2024-01-05", "film"), (5, "ＡＢ", "2024-01-05", "film"), (6, "何もない", "2024-01-05", "film")])
    raw = spark.createDataFrame([("学校に行く", "film"), ("AB!", "film"), (" ", "film")], "text string, name string")
    merged = spark.createDataFrame([("今日は学校", "film"), ("学校に行く", "film")], "text string, name string")
    c = memory.purge_candidates(raw, merged)
    at = lambda day: F.lit(day).cast("timestamp")
    plan = {r.id: (r.match, r.action, r.suspicious) for r in memory.purge_plan(tm, c).collect()}
    assert plan == {1: ("raw", "would_delete", False), 2: ("normalized", "would_delete", True), 3: ("normalized", "would_delete", True), 4: ("premerge", "would_delete", False), 5: ("normalized", "would_delete", False)}
    windowed = memory.purge_plan(tm, c, at("2024-01-05"), at("2024-02-01"), exclude=tm.filter("id = 4"))
    assert {r.id: r.action for r in windowed.collect()} == {1: "would_delete", 2: "would_keep_unknown_time", 4: "would_keep_excluded", 5: "would_delete"}
    assert {r.id: r.action for r in memory.purge_plan(tm, c, at("2024-01-05"), unknown_time=True).collect()}[2] == "would_delete"
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/purge-backup"
    assert sorted(r.id for r in memory.purged(tm, windowed, path).collect()) == [2, 3, 4, 6] and spark.read.parquet(path).count() == 6
    assert memory.purge_digest(memory.purge_plan(tm, c)).filter("match = 'normalized'").first().rows == 3


def test_fuzzy_folds_and_filters(spark):
    tm = entries(spark, [(1, "ABC  def", "2024-01-01", "f"), (2, "abcdefgh", "2024-01-01", "f"), (3, "zzzzzzzz", "2024-01-01", "f")])
    asked = spark.createDataFrame([(1, "abc def", 1), (2, "abc def", 2), (3, "  ", 1)], "query_id int, text string, stage int")
    found = {(r.query_id, r.id): round(r.similarity, 3) for r in memory.lookup_fuzzy(asked, tm, 0.6).collect()}
    assert found == {(1, 1): 1.0, (1, 2): 0.667}
    assert memory.lookup_fuzzy(asked.withColumn("source_lang", F.lit("en")), tm, 0.6).count() == 0


def test_full_text_folds(spark, tmp_path):
    tm = entries(spark, [(1, "ＦＵＬＬ width text", "2024-01-01", "f"), (2, "other", "2024-01-01", "f")])
    asked = spark.createDataFrame([(1, "full"), (2, "FULL Text"), (3, "full other")], "query_id int, text string")
    root = str(tmp_path / "index")
    search.create(spark, root)
    search.append(tm.select("id", F.concat_ws(" ", "source_text", "target_text").alias("text")), root)
    assert sorted((r.query_id, r.id) for r in search.search(asked, root).collect()) == [(1, 1), (2, 1)]


def test_probe_falls_back(spark):
    tm = entries(spark, [(1, "学校に行く", "2024-01-01", "f"), (2, "長い学校に行く話", "2024-01-01", "f"), (3, "50%引き", "2024-01-01", "f")])
    asked = spark.createDataFrame([(1, "学校に行く"), (2, "「学校に行く」"), (3, "行く話"), (4, "0%"), (5, "nothing")], "query_id int, text string")
    assert sorted((r.query_id, r.match, r.id) for r in memory.probe(asked, tm).collect()) == [(1, "exact", 1), (2, "normalised", 1), (3, "like", 2), (4, "like", 3)]


def test_promotion_with_backup(spark):
    tm, more = entries(spark, [(1, "a", "2024-01-01", "f")]), entries(spark, [(2, "a", "2024-01-01", "f"), (3, "b", "2024-01-01", "f")])
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/promotion-backup"
    assert memory.promoted(tm, more, path, dry_run=True).count() == 1
    assert sorted(r.id for r in memory.promoted(tm, more, path).collect()) == [1, 3] and spark.read.parquet(path).count() == 1


def test_numbered_replies(spark):
    body = "noise\n#1\nTranslation> one\n#7\nquoted\n#2\nTranslation>\ntwo\n\nlines\n#3\nthree\n#1\nTranslation> again"
    rows = assemble.parse_numbered(spark.createDataFrame([(1, 1, body, [1, 2, 3, 4])], "file_id long, batch_id int, body string, expected array<int>"))
    assert {r.idx: r.text for r in rows.collect()} == {1: "again", 2: "two\n\nlines", 3: "three"}


def test_watch_and_precedence(spark):
    log = spark.createDataFrame([(f"d{k}", {"a": (10, 1)}, {}) for k in range(3)], "date string, per_term map<string,struct<candidates:int,conflicts:int>>, manual_fp map<string,struct<count:int,category:string>>")
    assert glossary.evaluate_watch(log).first().advice == "insufficient"
    log = spark.createDataFrame([(f"d{k}", {"a": (200, 100)}, {"a": (1, "name")}) for k in range(3)], log.schema)
    assert glossary.evaluate_watch(log).first().advice == "not_ready"


def test_terms_in_unspaced_text(spark):
    rows = spaced(spark, ["黒猫がいる", "犬とcat", "categories"])
    terms = spark.createDataFrame([("黒猫", "a", [], 0), ("cat", "b", [], 1)], "src string, dst string, aliases array<string>, ord int")
    assert sorted((r.pos, r.src) for r in glossary.term_hits(rows, terms).collect()) == [(0, "黒猫"), (1, "cat")]


def test_language_signatures(spark):
    # text: valid Japanese, Chinese, English
    cases = {
        "": (1, 1, 1), "  ": (1, 1, 1), "你好": (1, 1, 0), "你好 ||| x": (1, 0, 1), "こんにちは": (1, 0, 0), "hello": (0, 0, 1), "123": (0, 0, 0), "I don't。": (0, 0, 1), "!?": (0, 0, 0),
        "今日は学校": (1, 1, 0), "カナ": (0, 0, 0), "OK。": (0, 0, 1), "痛い": (1, 1, 0), "你好 world": (0, 1, 1), "\x01你": (0, 0, 0), "♪♪": (0, 0, 0), "ﾃｽﾄ": (1, 1, 0), "行くのか": (1, 1, 0), "abc 你": (1, 1, 1),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in rows.select("t", *(validate.valid_target(F.col("t"), k).cast("int").alias(k) for k in ("ja", "zh", "en"))).collect():
        assert (r.ja, r.zh, r.en) == cases[r.t], r.t
    assert rows.filter("t = 'カナ'").select(validate.valid_target(F.col("t"), "ja", "カナ|OK").alias("v")).first().v


def test_learn_defects(spark):
    cases = [
        ("元気ですか", "[未翻译] 元気", "untranslated"), ("元気ですか", "Translation> 你好", "leak"), ("元気ですか", "你好ね", "kana"), ("元気ですか", "元気ですか", None), ("元気です", "元気で很好", "kana"), ("漢字原文", "漢字原译文好", "src_prefix"),
        ("元気ですか", "无对应条目", "placeholder"), ("とても長い原文です", "短", "len_ratio"), ("元気です", "好" * 33, "len_ratio"), ("うん", "好" * 30, None), ("元気ですか", "你好吗", None),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, s string, t string, reason string")
    for r in rows.withColumn("got", validate.learn_defect(F.col("s"), F.col("t"))).collect():
        assert r.got == r.reason, r
    orig, final = spaced(spark, ["元気ですか", "同じ", "行きます", "来ます", "見ます"]), spaced(spark, ["你好吗", "同じ", "[未翻译] x", "来了ね", "看"])
    flagged = final.filter("pos in (3, 4)")
    assert {r.pos: r.reason for r in validate.learn_admission(final, orig, {"must_see": flagged.filter("pos = 4")}).collect()} == {0: None, 1: "no_pair", 2: "no_pair", 3: "kana", 4: "must_see"}


def test_three_lanes(spark):
    merged = cues(spark, [(0, 2000, "m"), (5000, 6000, "alone"), (10_000, 12_000, "x"), (20_000, 22_000, "y"), (30_000, 31_000, "z")])
    first = cues(spark, [(0, 2000, "今日は、良い天気！"), (5000, 6000, "alone"), (10_000, 12_000, "うん"), (20_000, 22_000, "あ"), (30_000, 31_000, "学校に行きました")])
    second = cues(spark, [(500, 2500, "今日は良い天気"), (10_000, 11_000, "全然違う文です"), (20_000, 26_000, "長い文の話をする"), (30_000, 31_000, "猫が鳴いている夜")])
    rows = {r.pos: r for r in passes.review_groups(passes.disagreement(merged, first, second)).collect()}
    assert sorted(rows) == [0, 2, 3, 4]
    assert (rows[0].similarity, rows[0].iou, rows[0].offset_s, rows[0].group) == (1.0, 0.6, 0.5, "none")
    assert rows[2].artifact and rows[2].interjection and rows[2].group == "artifact"
    assert rows[3].artifact and not rows[3].interjection and (rows[3].iou, rows[3].offset_s) == (0.3333, 4.0)
    assert rows[4].group == "must_see" and not rows[4].artifact
    labelled = passes.disagreement(merged, first, second).withColumn("label", F.when(F.col("pos") == 3, "C").otherwise("A"))
    grid = {(r.iou_limit, r.offset_limit): r for r in passes.threshold_grid(labelled).filter("rule = 'historical'").collect()}
    now = passes.threshold_grid(labelled).filter("rule = 'current'").select("a_alive", "b_alive", "c_cleared").distinct().collect()
    assert [tuple(r) for r in now] == [(2 / 3, None, 0.0)]
    assert len(grid) == 16 and grid[0.35, 3.0].c_cleared == 1.0 and grid[0.2, 3.0].c_cleared == 0.0 and grid[0.2, 1.5].b_alive is None and abs(grid[0.2, 1.5].a_alive - 2 / 3) < 1e-9


def test_short_runs_are_protected(spark):
    rows = cues(spark, [(0, 500, "好"), (1000, 1500, "好"), (2000, 2500, "好"), (60_000, 61_000, "好"), (120_000, 121_000, "老师"), (180_000, 181_000, "第3集"), (240_000, 241_000, "订阅第3集")]).withColumn("evidence", F.array(F.lit("ああああああ")))
    found = {r.pos: (r.rule, r.deleted) for r in clean.judged(rows, CLEAN).collect()}
    assert [found[k] for k in range(3)] == [("protected-run", False)] * 3 and found[3] == ("L8-short-response", True)
    assert found[4] == ("L0-hardened", False) == found[5] and found[6] == ("L0-hardened", False)


def test_the_whole_cleaner(spark):
    rows = cues(spark, [(0, 500, "我，"), (600, 1500, "去"), (60_000, 61_000, "好"), (120_000, 121_000, "哇")])
    source = cues(spark, [(0, 500, "私"), (60_000, 61_000, "ああああああ"), (120_000, 121_000, "漢字")])
    kept, stats = clean.cleaned(rows, source, CLEAN)
    assert [(r.idx, r.text) for r in kept.orderBy("idx").collect()] == [(1, "我， 去"), (2, "哇")]
    r = stats.first()
    assert (r.merged, r.deleted, r.kept_by_source, dict(r.by_rule)) == (1, 1, 1, {"L8-short-response": 1})


def test_one_to_one_across_long_stretches(spark):
    left = cues(spark, [(595_000, 599_900, "a"), (599_950, 605_000, "b"), (700_000, 701_000, "c")])
    right = cues(spark, [(596_000, 604_000, "only"), (700_100, 700_250, "short")])
    assert [(r.pos, r.r_pos) for r in compare.side_by_side(left, right).collect()] == [(0, 0)]


def test_garbled_sources_with_fluent_targets(spark):
    orig = spaced(spark, ["じゃあじゃあじゃあじゃあ", "うん", "漢字あああああああ", "話です", "ああああああ"])
    final = spaced(spark, ["我们去吧", "好的", "我们走吧", "说话", "[未翻译] ああああああ"])
    found = {r.pos: r.signal for r in gate.garble_review(final, orig, orig.filter("pos in (0, 1)")).collect()}
    assert found == {0: "nonsense_syllables", 1: "counted"}


def test_grammar_hints(spark):
    rows = spark.createDataFrame([("これはペンだけど", ""), ("僕たち三人で", ""), ("東京の空", ""), ("行ったのね", "彼は来た"), ("行ったのね", "来た"), ("plain", "")], "t string, before string")
    found = [r.h for r in rows.select(T.grammar_hints(F.col("t"), F.col("before")).alias("h")).collect()]
    assert found == [["contrast"], ["plural_adnominal"], ["modifier"], ["modifier", "omitted_subject"], ["modifier"], []]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.acronym(F.lit("the NASA man"))) == "NASA" and one(T.acronym(F.lit("xNASAx A"))) is None
    assert one(T.report_line(F.lit("TM: 3"))) == one(T.report_line(F.lit("TM: 4"))) and one(T.report_line(F.lit("时间: 2024-01-01 10:00:00 x"))) == "时间: <归一化> x"


def test_contradiction(spark):
    support = {"pass1": "左边|pass1", "pass2": "右边|pass2", "phrases": "准确|通顺"}
    rows = spark.createDataFrame([("左边更准确", "pass2"), ("左边不准确", "pass2"), ("右边通顺", "pass2"), ("左边准确；右边通顺", "pass2"), ("左边准确", None)], "reason string, side string")
    found = [r.x for r in rows.select(review.contradiction(F.col("reason"), F.col("side"), support).alias("x")).collect()]
    assert found == ["FAIL", "", "", "LOW_FLAG", ""]


def test_verdicts_and_evidence(spark):
    body = 'Sure:\n```json\n[{"row": 1, "category": 1, "side": "pass1", "evidence_timing": "00:00:10,500", "evidence_pass": "pass1", "confidence": "high", "reason": "「学校に行く」と言う"}, {"row": 1, "category": 2, "reason": "later"}, {"row": 2, "category": 9, "reason": "bad"}, {"row": 3, "category": 1, "side": "pass1", "evidence_timing": "00:00:10,500", "evidence_pass": "pass1", "confidence": "high", "reason": "「どこにもない文」"}, {"row": 4, "category": 1, "side": "pass1", "evidence_timing": "01:00:00,000", "evidence_pass": "pass1", "confidence": "high", "reason": ""}, {"row": 5, "category": 3, "confidence": "high", "reason": ""}]\n```'
    replies = spark.createDataFrame([(1, body)], "batch int, body string")
    rows = review.verdicts(replies, spark.createDataFrame([(1, k) for k in range(1, 7)], "batch int, row int"))
    window = F.array(F.struct(F.lit(10_000).cast("long").alias("start_ms"), F.lit("…学校 に行く").alias("text")))
    found = {r.row: (r.category, r.filled, r.verify, r.confidence) for r in review.verify_evidence(rows.withColumn("window", window)).collect()}
    assert found == {1: (1, False, "PASS", "high"), 2: (4, True, "N/A", "low"), 3: (1, False, "FAIL", "low"), 4: (1, False, "FAIL", "low"), 5: (3, False, "N/A", "high"), 6: (4, True, "N/A", "low")}


def test_sidecars(spark):
    lines = spark.createDataFrame([(1, 1, '{"scene": 1, "audio_duration_s": 2}'), (1, 2, "{bad"), (1, 3, '{"scene": 1, "audio_duration_s": 9}')], "file_id long, line_no int, value string")
    good, bad = sidecars.scene_telemetry(lines)
    assert [(r.scene, r.audio_duration_s) for r in good.collect()] == [(1, 2.0)] and bad.first().bad_lines == 1
    names = spark.createDataFrame([("film.pass1.srt",), ("film.pass2.srt",), ("solo.pass1.srt",), ("other.txt",)], "name string")
    assert {r.base: r.mode for r in sidecars.lanes(names).collect()} == {"film": "dual", "solo": "missing"}
    log = spark.createDataFrame([(1, k, v) for k, v in enumerate(["23:59:50 run start", "23:59:55 batch 1", "00:00:05 batch 2"])], "file_id long, line_no int, value string")
    assert [r.seconds for r in sidecars.log_batches(log).orderBy("batch").collect()] == [None, 10]
    ctx = spark.createDataFrame([(1, k, v) for k, v in enumerate(["x => y", "【剧情摘要】a story", "# no", "【误听怀疑】", "foo => bar", "foo =>", "no pair"])], "file_id long, line_no int, value string")
    assert [(r.kind, r.value, r.suspect, r.correct) for r in sidecars.context_sidecar(ctx).orderBy("line_no").collect()] == [("summary", "a story", "", ""), ("mishear", "foo => bar", "foo", "bar")]


def test_verdicts_are_valid_or_filled(spark):
    base = {"category": 1, "side": "pass1", "evidence_pass": "pass2", "confidence": "high", "reason": "r", "evidence_timing": "t"}
    odd = [{}, {"side": None, "evidence_pass": None}, {"side": "left"}, {"evidence_pass": "both"}, {"confidence": None}, {"confidence": "sure"}, {"category": 6}, {"reason": None}]
    body = json.dumps([base | {"row": k} | x for k, x in enumerate(odd)])
    replies = spark.createDataFrame([(1, body)], "batch int, body string")
    rows = {r.row: r for r in review.verdicts(replies, spark.createDataFrame([(1, k) for k in range(len(odd))], "batch int, row int")).collect()}
    assert [rows[k].filled for k in range(len(odd))] == [False, False, True, True, True, True, True, True]
    assert (rows[4].category, rows[4].side, rows[4].confidence, rows[4].reason) == (4, None, "low", "") and rows[1].side is None


def test_a_majority_is_an_event(spark):
    totals = spark.createDataFrame([(1, 10, 10), (2, 10, 1)], "file_id int, total int, kept int")
    events = quality.risk_events(spark.createDataFrame([(2, 1, "t", "final", "long", "cut", "warning")], "file_id int, idx int, timing string, stage string, reason string, action string, severity string"))
    files = quality.risk_files(events, totals)
    found = {r.file_id: (r.warning, r.critical, r.untranslated_majority, r.degraded) for r in files.collect()}
    assert found == {1: (0, 1, True, True), 2: (1, 0, False, True)}
    (event,) = quality.majority_events(files).collect()
    assert (event.file_id, event.severity, event.affected) == (1, "critical", 0) and "10/10" in event.reason


def test_garbage_matches_at_the_start(spark):
    rules = clean.CleanRules(garbage=("ab+c", "x|yz"), sensory=("soft",), particles=("so", "much"), degrees=("quite",), beside=("so", "quite"))
    rows = cues(spark, [(k * 100_000, k * 100_000 + 900, t) for k, t in enumerate(["hello abbc there", "abbc there", "then x", "yz", "so soft quite", "much soft"])]).withColumn("evidence", F.array(F.lit("ああああああ")))
    found = {r.pos: r.rule for r in clean.judged(rows, rules).collect()}
    assert [found[k] for k in range(6)] == ["keep", "L5-garbage", "keep", "L5-garbage", "L7-sensory", "keep"]


def test_torn_memory_rows_are_rejected(spark, tmp_path):
    (tmp_path / "tm.csv").write_text('source,target\n"a ""quoted"", text","x, y"\n"torn \\"quote\\", text, one, two, three, four, five",b\n"two\nlines",c\n', encoding="utf-8")
    path = str(tmp_path / "tm.csv")
    rows = sidecars.import_memory(spark, path, "en", "fr").collect()
    assert {(r.source_text, r.target_text, r.source_lang) for r in rows} == {('a "quoted", text', "x, y", "en"), ("two\nlines", "c", "en")}
    assert sidecars.rejected_memory(spark, path).count() == 1


def test_evidence_of_all_rows_inside(spark):
    merged = cues(spark, [(0, 3000, "ab"), (20_000, 21_000, "c")]).withColumn("members", F.lit(2))
    before = cues(spark, [(0, 1000, "a"), (0, 1000, "a again"), (1000, 3001, "b"), (2500, 3002, "sticks out"), (9000, 30_000, "longer")])
    source = cues(spark, [(0, 1000, "s1"), (0, 1000, "s2"), (1000, 3001, "s3"), (2500, 3002, "s4"), (9000, 30_000, "s5")])
    found = {r.pos: r.evidence for r in merge.evidence(merged, before, source).collect()}
    assert found == {0: ["s1", "s2", "s3"], 1: None}


def test_hint_echoes_and_placeholders(spark):
    rows = spark.createDataFrame([
        (0, "【语法提示】a\nb\n原文：text", "text", "text"), (1, "【语法提示】rest of line\nkept", "kept", "kept"), (2, "a\n原文：x ||| y\nb", "a\n\nb", "a\n\nb"), (3, "in 原文：stays", "in 原文：stays", "in 原文：stays"),
        (4, "jp ||| zh ||| last", "last", "last"), (5, "[Grammar Tip] x\n\nWord segmentation: y\n\nEnglish: hello", "[Grammar Tip] x\n\nWord segmentation: y\n\nEnglish: hello", "hello"),
        (6, "one\nSource: x\n**Final:**\nOriginal: z\ntwo", "one\nSource: x\n**Final:**\nOriginal: z\ntwo", "one\n\ntwo"), (7, None, None, None),
    ], "k int, t string, zh string, en string")
    for r in rows.withColumns({"a": T.strip_hint_echo(F.col("t")), "b": T.strip_hint_echo(F.col("t"), "en")}).collect():
        assert (r.a, r.b) == (r.zh, r.en), r.k
    texts = [(0, "（削除：ASR杂音）", None), (1, "(删 除：孤立)", None), (2, "呼吸声", None), (3, "plain", "plain"), (4, "本批次全部保留", None), (5, "a\r\nNote: b\r\nc", "a\nc"), (6, "注：x\nok", "ok"), (7, None, None), (8, "see #4", None), (9, "（说 删除", "（说 删除")]
    kept = {r.pos: r.text for r in validate.replied_rows(spark.createDataFrame([(k, t) for k, t, _ in texts], "pos int, text string")).collect()}
    assert kept == {k: want for k, _, want in texts if want is not None}


def test_places_in_a_total_order(spark):
    from cuelake.plans.ranks import ranked

    rows = [(k, (k * 7919) % 101 if k % 9 else None) for k in range(500)]
    out = ranked(spark.createDataFrame(rows, "k int, v int").repartition(7), "place", F.desc("v"), F.col("k")).collect()
    order = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1), r[0]))
    assert {(r.k, r.place) for r in out} == {(k, i) for i, (k, _) in enumerate(order, 1)}
    assert ranked(spark.createDataFrame([], "k int"), "place", F.col("k")).count() == 0


def test_verified_pairs_of_a_common_word(spark):
    texts = spark.createDataFrame([(1, k, f"the word{k} end", f"der wort{k} ende") for k in range(300)] + [(2, 0, "the other", "das andere")], "file_id int, pos int, source string, target string")
    pairs = [(1, "the", f"wort{k}") for k in range(300)] + [(1, f"word{k}", "der") for k in range(300)] + [(1, "the", "das"), (2, "the", "das"), (2, "word1", "der"), (1, "word1", "wort2"), (1, "same", "same"), (1, "", "der"), (2, "OTHER", "andere"), (2, "other", "andere")]
    known = spark.createDataFrame([("WORD7",)], "src string")
    found = {tuple(r) for r in validate.verified_pairs(spark.createDataFrame(pairs, "file_id int, src string, dst string"), texts, known).collect()}
    assert found == {("the", f"wort{k}") for k in range(300)} | {(f"word{k}", "der") for k in range(300) if k != 7} | {("the", "das"), ("other", "andere")}
