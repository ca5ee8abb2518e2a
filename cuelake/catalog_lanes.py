"""Queries on lanes of the same files: merging, cleaning, validation, overlap joins, comparison, audio, review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import assemble, audio, clean, compare, merge, passes, quality, review, validate
from cuelake.plans.islands import neighbours
from cuelake.registry import query
from cuelake.sources import adapters as A

_OVERLAP = """
WITH ov AS (SELECT a.file_id, a.pos, a.start_ms, a.end_ms, a.text, b.pos AS r_pos, b.start_ms AS r_start_ms, b.end_ms AS r_end_ms, b.text AS r_text,
    least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms
  FROM cues AS a JOIN pass2 AS b ON a.file_id = b.file_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms),
best AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY file_id, pos ORDER BY overlap_ms DESC, r_pos) = 1)
"""


@query("CUES", "PASS2", sql=_OVERLAP + "SELECT c.file_id, c.pos, best.r_pos, best.overlap_ms FROM cues AS c LEFT JOIN best ON c.file_id = best.file_id AND c.pos = best.pos")
def best_overlap(spark, d):
    c = A.cues(spark, d)
    return passes.best_overlap(c, A.second_pass(c)).select("file_id", "pos", "r_pos", "overlap_ms")


_NORM = r"""regexp_replace({}, '[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}，。、！？…!?~〜·「」『』,.!?：:；;（）()【】《》〈〉\[\]"''“”‘’—－_／/]+', '', 'g')"""
_DISAGREE = """
WITH o1 AS (SELECT m.file_id, m.pos, b.pos AS pos1, b.start_ms AS s1, b.end_ms AS e1, b.text AS t1 FROM merged AS m JOIN cues AS b ON m.file_id = b.file_id AND m.start_ms < b.end_ms AND b.start_ms < m.end_ms
  QUALIFY row_number() OVER (PARTITION BY m.file_id, m.pos ORDER BY least(m.end_ms, b.end_ms) - greatest(m.start_ms, b.start_ms) DESC, b.pos) = 1),
o2 AS (SELECT m.file_id, m.pos, b.pos AS pos2, b.start_ms AS s2, b.end_ms AS e2, b.text AS t2 FROM merged AS m JOIN pass2 AS b ON m.file_id = b.file_id AND m.start_ms < b.end_ms AND b.start_ms < m.end_ms
  QUALIFY row_number() OVER (PARTITION BY m.file_id, m.pos ORDER BY least(m.end_ms, b.end_ms) - greatest(m.start_ms, b.start_ms) DESC, b.pos) = 1),
n AS (SELECT *, greatest(0, least(e1, e2) - greatest(s1, s2)) AS ov, """ + _NORM.format("t1") + " AS n1, " + _NORM.format("t2") + """ AS n2 FROM o1 JOIN o2 USING (file_id, pos)),
g AS (SELECT *, round_even(ov / ((e1 - s1) + (e2 - s2) - ov), 4) AS iou, round_even(greatest(abs(s1 - s2), abs(e1 - e2)) / 1000, 3) AS offset_s, least(length(n1), length(n2)) AS short, greatest(length(n1), length(n2)) AS long FROM n)
"""


def _lanes(spark, d, by_file=False):
    c = A.cues(spark, d, by_file)
    return A.merged(c), c, A.second_pass(c)


@query("CUES", "MERGED", "PASS2", sql=_DISAGREE + "SELECT file_id, pos, pos1, pos2, iou, offset_s, short, long FROM g")
def pass_disagreement(spark, d):
    """The rows of both passes beside each merged row; similarity is in the next query, SQL has no such measure."""
    return passes.disagreement(*_lanes(spark, d), texts=False).select("file_id", "pos", "pos1", "pos2", "iou", "offset_s", "short", "long")


@query()
def pass_disagreement_blocks(spark, d):
    """With similarity by matching blocks, in Arrow batches; held against brute force in the tests."""
    return passes.review_groups(passes.disagreement(*_lanes(spark, d))).select("file_id", "pos", "pos1", "pos2", "similarity", "artifact", "group")


_BY_LENGTH = _DISAGREE + """, s AS (SELECT *, CASE WHEN short = 0 THEN 0::DOUBLE ELSE short / long END AS similarity FROM g),
a AS (SELECT *, short <= 3 AND long >= 4 AND similarity < 0.3 AS artifact FROM s),
r AS (SELECT *, CASE WHEN artifact THEN 'artifact' WHEN similarity < 0.3 THEN 'must_see' WHEN similarity < 0.5 THEN 'optional' ELSE 'none' END AS "group" FROM a)
"""


def by_length(spark, d, texts=False, by_file=False):
    """The comparison with the ratio of lengths as similarity, which SQL has too."""
    rows = passes.disagreement(*_lanes(spark, d, by_file), texts=texts).withColumn("similarity", F.when(F.col("short") == 0, 0.0).otherwise(F.col("short") / F.col("long")))
    artifact = F.col("interjection") | ((F.col("short") <= passes.SHORT_MOST) & (F.col("long") >= passes.LONG_LEAST) & (F.col("similarity") < passes.STRICT))
    return passes.review_groups(rows.withColumn("artifact", artifact))


@query("CUES", "MERGED", "PASS2", sql=_BY_LENGTH + """SELECT CASE WHEN similarity < 0.3 THEN 'strict' WHEN similarity < 0.5 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS rows, count(*) FILTER (artifact) AS artifacts FROM r GROUP BY 1""")
def similarity_buckets(spark, d):
    return passes.similarity_buckets(by_length(spark, d))


@query("CUES", "MERGED", "PASS2", sql=_BY_LENGTH + """SELECT file_id, pos, iou, offset_s, row_number() OVER (PARTITION BY file_id ORDER BY iou, offset_s DESC, pos) AS rank FROM r WHERE artifact QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY iou, offset_s DESC, pos) <= 5""")
def artifact_sample(spark, d):
    return passes.artifact_sample(by_length(spark, d)).select("file_id", "pos", "iou", "offset_s", "rank")


@query("CUES", "MERGED", "PASS2", sql=_DISAGREE + """, l AS (SELECT *, CASE WHEN short < 10 THEN 'C' WHEN long > 60 THEN 'A' ELSE 'B' END AS label FROM g),
c AS (SELECT *, rule = 'historical' AND iou < i AND offset_s > o AS gone FROM l, (SELECT unnest(['current', 'historical']) AS rule), (SELECT unnest([0.2::DOUBLE, 0.25, 0.3, 0.35]) AS i), (SELECT unnest([1.5::DOUBLE, 2.0, 2.5, 3.0]) AS o))
SELECT rule, i AS iou_limit, o AS offset_limit, count(*) FILTER (label = 'A' AND NOT gone) / count(*) FILTER (label = 'A') AS a_alive, count(*) FILTER (label = 'B' AND NOT gone) / count(*) FILTER (label = 'B') AS b_alive,
  count(*) FILTER (label <> 'C' AND NOT gone) / count(*) FILTER (label <> 'C') AS ab_alive, count(*) FILTER (label = 'C' AND gone) / count(*) FILTER (label = 'C') AS c_cleared FROM c GROUP BY ALL""")
def threshold_grid(spark, d):
    label = F.when(F.col("short") < 10, "C").when(F.col("long") > 60, "A").otherwise("B")
    return passes.threshold_grid(passes.disagreement(*_lanes(spark, d), texts=False).withColumn("label", label))


@query("CUES", "PASS2", sql="""WITH m AS (SELECT file_id, pos, (start_ms + end_ms) // 2 AS mid FROM cues), o AS (SELECT file_id, (start_ms + end_ms) // 2 AS mid FROM pass2)
SELECT file_id, pos FROM m WHERE NOT EXISTS (FROM o WHERE o.file_id = m.file_id AND abs(o.mid - m.mid) <= 400)""")
def unmatched_rows(spark, d):
    c = A.cues(spark, d)
    return passes.unmatched(c, A.second_pass(c), 400).select("file_id", "pos")


@query("CUES", "RUN_EVENTS", "TELEMETRY", sql="""
WITH b AS (SELECT file_id, scene, greatest(audio_duration_s, 0) AS dur, round(sum(greatest(audio_duration_s, 0)) OVER (PARTITION BY file_id ORDER BY scene), 6) AS hi FROM telemetry),
m AS (SELECT file_id, pos, (start_ms + end_ms) / 2000 AS mid FROM cues)
SELECT m.file_id, m.pos, min(b.scene) AS scene FROM m LEFT JOIN b ON m.file_id = b.file_id AND dur > 0 AND mid <= hi AND (mid > round(hi - dur, 6) OR (round(hi - dur, 6) = 0 AND mid <= 0)) GROUP BY m.file_id, m.pos""")
def scene_assign(spark, d):
    return passes.assign_scenes(A.cues(spark, d), A.telemetry(spark, d)).select("file_id", "pos", "scene")


@query("CUES", "RUN_EVENTS", "TELEMETRY", sql=r"""
WITH b AS (SELECT file_id, scene, greatest(audio_duration_s, 0) AS dur, round(sum(greatest(audio_duration_s, 0)) OVER (PARTITION BY file_id ORDER BY scene), 6) AS hi FROM telemetry),
m AS (SELECT file_id, pos, (start_ms + end_ms) / 2000 AS mid, length(regexp_replace(text, '\s', '', 'g')) / ((end_ms - start_ms) / 1000) AS cps FROM cues WHERE end_ms - start_ms >= 500)
SELECT m.file_id, b.scene, count(*) AS rows, round(avg(cps), 6) AS cps FROM m JOIN b ON m.file_id = b.file_id AND dur > 0 AND mid < hi AND mid >= round(hi - dur, 6) GROUP BY ALL""")
def scene_cps(spark, d):
    rows = passes.assign_scenes(quality.with_cps(A.cues(spark, d)).filter("cps is not null"), A.telemetry(spark, d), closed=False).filter("scene is not null")
    return rows.groupBy("file_id", "scene").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("cps"), 6).alias("cps"))


@query("CUES", "FINAL", sql="""SELECT f.file_id, f.pos, c.pos AS orig_pos, c.idx AS orig_idx FROM final AS f LEFT JOIN cues AS c ON f.file_id = c.file_id AND f.start_ms = c.start_ms
QUALIFY row_number() OVER (PARTITION BY f.file_id, f.pos ORDER BY c.pos) = 1""")
def align_by_start(spark, d):
    c = A.cues(spark, d)
    return passes.align_by_start(A.final(c), c).select("file_id", "pos", "orig_pos", "orig_idx")


@query("CUES", sql="""WITH t AS (SELECT file_id, pos AS target FROM cues WHERE length(text) > 60)
SELECT t.file_id, target, string_agg(c.text, '|' ORDER BY c.pos) AS context FROM t JOIN cues AS c ON c.file_id = t.file_id AND c.pos BETWEEN target - 5 AND target + 5 GROUP BY ALL""")
def review_context(spark, d):
    c = A.cues(spark, d, by_file=True)
    return passes.context_windows(c.filter("length(text) > 60"), c).withColumn("context", F.array_join("context", "|"))


# -- merging and cleaning: sequential folds, held against brute force in the tests ----------------------------

@query()
def fragment_merge(spark, d):
    c = A.cues(spark, d).withColumn("text", F.regexp_replace("text", r"[^,]$", ","))
    return merge.merge_fragments(c)


@query()
def premerge(spark, d):
    return merge.premerge(A.cues(spark, d))


#: Rules of the catalogue, for Latin script.
_TINY = clean.CleanRules(sensory=("tion", "heit"), short=("Un", "Of", "On"), exclamations=("Es", "In"), fillers=("And", "The"), addresses=("ing",), actions=("is", "est"), particles=("en",), degrees=("very",), beside=("en", "s"), hardened=("zz",), hardened_patterns=("[0-9]{4}",), meta_strong=("License",), meta_weak=("MIT",), garbage=(r"^[.!?]+$",))


@query()
def clean_rules(spark, d):
    c = A.cues(spark, d)
    rows = c.withColumn("evidence", F.when(F.col("pos") % 3 > 0, F.array(F.when(F.col("pos") % 2 == 0, "ああああああ").otherwise("abc"))))
    return clean.judged(rows, _TINY).select("file_id", "pos", "segment", "rule", "deleted")


@query()
def clean_files(spark, d):
    """The whole cleaner: merging, evidence from another lane, verdicts, statistics."""
    c = A.cues(spark, d, by_file=True)
    source = c.filter("pos % 3 > 0").withColumn("text", F.when(F.col("pos") % 2 == 0, "ああああああ").otherwise("abc"))
    _, stats = clean.cleaned(c, source, _TINY)
    return stats.withColumn("by_rule", F.array_join(F.transform(F.map_entries("by_rule"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("CUES", sql="""WITH s AS (SELECT *, coalesce(start_ms - lag(end_ms) OVER (PARTITION BY file_id ORDER BY pos) > 1500, true) AS b FROM cues)
SELECT file_id, pos, sum(b::INT) OVER (PARTITION BY file_id ORDER BY pos)::BIGINT AS segment FROM s""")
def segments(spark, d):
    c = A.cues(spark, d).withColumn("evidence", F.array(F.lit("x")))
    return clean.judged(c, _TINY).select("file_id", "pos", "segment")


@query("CUES", sql="""WITH p AS (SELECT *, length(text) <= 10 AND NOT regexp_matches(replace(replace(replace(replace(regexp_replace(text, '[，。、！？\\s,.!?…~～]', '', 'g'), 'tion', ''), 'heit', ''), 'en', ''), 'very', ''), 'is|est') AS plain FROM cues),
b AS (SELECT *, NOT plain OR NOT coalesce(lag(plain) OVER w, false) OR coalesce(start_ms - lag(end_ms) OVER w > 3000, true) AS brk FROM p WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
r AS (SELECT *, sum(brk::INT) OVER (PARTITION BY file_id ORDER BY pos) AS run FROM b)
SELECT file_id, pos, text FROM r WHERE plain QUALIFY count(*) OVER (PARTITION BY file_id, run) >= 3""".replace("\\\\", "\\"))
def short_runs(spark, d):
    return clean.short_runs(A.cues(spark, d), _TINY).select("file_id", "pos", "text")


_INVALID = r"""WITH v AS (SELECT *, trim(text) <> '' AND (regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') OR regexp_matches(text, '[\x{3040}-\x{30ff}]') OR NOT regexp_matches(text, '[A-Za-z]')) AS invalid FROM final),
f AS (SELECT *, avg(invalid::DOUBLE) OVER (PARTITION BY file_id) <= 0.5 AS ok FROM v)
"""


@query("CUES", "FINAL", sql=_INVALID + "SELECT file_id, pos, invalid, invalid AND ok AS dropped FROM f")
def language_filter(spark, d):
    rows = A.final(A.cues(spark, d))
    return validate.language_filter(rows, ~validate.valid_target(F.col("text"), "en")).select("file_id", "pos", "invalid", "dropped")


@query("CUES", "FINAL", sql=r"""WITH t AS (SELECT file_id, pos, trim(text) AS s FROM final)
SELECT file_id, pos, CASE WHEN s = '' THEN true WHEN contains(s, ' ||| ') OR regexp_matches(s, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN false WHEN regexp_full_match(s, '[A-Za-z\s\p{Z}\p{Nd}.,!?''"\-:;()/\\]+') THEN false
  WHEN regexp_matches(s, '[A-Za-z]') AND regexp_full_match(s, '[A-Za-z\s\p{Z}\p{Nd}.,!?''"\-:;()/\\\x{3000}-\x{303f}\x{ff01}-\x{ff60}\x{ffe0}-\x{ffe6}]+') THEN false
  WHEN NOT regexp_matches(s, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{31f0}-\x{31ff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]') THEN false
  WHEN NOT regexp_matches(s, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]') AND regexp_matches(s, '[\x{3040}-\x{30ff}]') THEN false ELSE true END AS valid FROM t""")
def language_signature(spark, d):
    """The marked rows of the final lane hold Han; the others are Latin."""
    return A.final(A.cues(spark, d)).select("file_id", "pos", validate.valid_target(F.col("text"), "zh").alias("valid"))


@query("CUES", "FINAL", sql=_INVALID + "SELECT file_id, pos, CASE WHEN invalid AND ok THEN '[未翻译] ' || text ELSE text END AS text FROM f")
def language_mark(spark, d):
    rows = A.final(A.cues(spark, d))
    return validate.language_mark(rows, ~validate.valid_target(F.col("text"), "en")).select("file_id", "pos", "text")


@query("CUES", "FINAL", sql=r"""WITH p AS (SELECT f.file_id, f.idx, c.text AS source, f.text AS target FROM final AS f JOIN cues AS c USING (file_id, pos))
SELECT file_id, idx, CASE WHEN regexp_matches(source, 'the') AND regexp_matches(target, 'THE') THEN regexp_replace(target, 'THE', 'DIE', 'g') ELSE target END AS fixed,
  concat_ws(',', CASE WHEN regexp_matches(source, 'and') AND regexp_matches(target, 'AND') THEN 'and' END, CASE WHEN regexp_matches(source, 'des') AND regexp_matches(target, 'DES') THEN 'des' END) AS warnings FROM p""")
def mistranslation_scan(spark, d):
    c = A.cues(spark, d)
    pairs = A.final(c).select("file_id", "idx", "pos", F.col("text").alias("target")).join(c.select("file_id", "pos", F.col("text").alias("source")), ["file_id", "pos"])
    out = validate.mistranslations(pairs, [("and", "and", "AND", None), ("des", "des", "DES", None), ("the", "the", "THE", "DIE")])
    return out.select("file_id", "idx", "fixed", F.array_join("warnings", ",").alias("warnings"))


@query("CUES", "FINAL", sql=r"""WITH a AS (SELECT f.file_id, f.pos, trim(CASE WHEN length(f.text) % 9 = 4 THEN f.text || ' Translation' WHEN length(f.text) % 9 = 5 THEN c.text || f.text WHEN length(f.text) % 9 = 6 THEN '' ELSE f.text END) AS t, trim(c.text) AS s
  FROM final AS f JOIN (FROM cues QUALIFY row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) = 1) AS c USING (file_id, start_ms, end_ms))
SELECT file_id, pos, CASE WHEN s = '' OR t = '' OR starts_with(t, '[未翻译]') OR s = t THEN 'no_pair' WHEN length(s) < 12 THEN 'flagged' WHEN contains(t, 'Translation') THEN 'leak' WHEN length(t) > length(s) AND starts_with(t, s[1:greatest(1, length(s) - 1)]) THEN 'src_prefix'
  WHEN length(s) * 0.5 >= 4 AND (length(t) / length(s) < 0.25 OR length(t) / length(s) > 8) THEN 'len_ratio' ELSE 'learnt' END AS reason FROM a""")
def learn_admission(spark, d):
    c = A.cues(spark, d)
    src = c.select("file_id", "pos", F.col("text").alias("s"))
    n = F.length("text") % 9
    text = F.when(n == 4, F.concat("text", F.lit(" Translation"))).when(n == 5, F.concat("s", "text")).when(n == 6, "").otherwise(F.col("text"))
    f = A.final(c).join(src, ["file_id", "pos"]).withColumn("text", text).drop("s")
    rows = validate.learn_admission(f, c, {"flagged": c.filter("length(trim(text)) < 12").select("file_id", "idx")})
    return rows.select("file_id", "pos", F.coalesce("reason", F.lit("learnt")).alias("reason"))


@query("CUES", "FINAL", sql="SELECT file_id, pos, CASE WHEN length(text) > 80 THEN lower(text) || '!' ELSE text END AS text FROM final")
def apply_retranslations(spark, d):
    f = A.final(A.cues(spark, d))
    accepted = f.filter("length(text) > 80").select("file_id", "pos", F.concat(F.lower("text"), F.lit("!")).alias("new_text"))
    return validate.apply_retranslations(f, accepted)[0].select("file_id", "pos", "text")


@query("CUES", "FINAL", sql="""WITH n AS (SELECT file_id, pos, CASE WHEN length(text) % 31 = 1 THEN start_ms + 1 ELSE start_ms END AS start_ms, end_ms, CASE WHEN length(text) % 29 = 2 OR length(text) > 80 THEN lower(text) || '!' ELSE text END AS text FROM final WHERE length(text) % 37 <> 3)
SELECT f.file_id, f.pos, CASE WHEN n.pos IS NULL THEN 'row_count' WHEN f.start_ms <> n.start_ms OR f.end_ms <> n.end_ms THEN 'timing' ELSE 'text' END AS violation FROM final AS f LEFT JOIN n USING (file_id, pos)
WHERE n.pos IS NULL OR f.start_ms <> n.start_ms OR (f.text <> n.text AND length(f.text) <= 80)""")
def retranslation_violations(spark, d):
    """A tampered version against the original: rows lost, spans moved, texts touched that nobody selected."""
    f = A.final(A.cues(spark, d))
    n = F.length("text")
    bad = f.filter(n % 37 != 3).withColumns({"start_ms": F.when(n % 31 == 1, F.col("start_ms") + 1).otherwise(F.col("start_ms")), "text": F.when((n % 29 == 2) | (n > 80), F.concat(F.lower("text"), F.lit("!"))).otherwise(F.col("text"))})
    return validate.violations(f, bad, f.filter("length(text) > 80"))


@query("CUES", "FINAL", sql="""WITH c AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS k FROM cues), s AS (SELECT file_id, start_ms, end_ms, bool_and(starts_with(text, '[未翻译]')) AS u FROM final GROUP BY ALL)
SELECT file_id, pos, CASE WHEN u IS NULL THEN 'missing' WHEN u THEN 'untranslated' ELSE 'covered' END AS state FROM c LEFT JOIN s USING (file_id, start_ms, end_ms)""")
def coverage_miss(spark, d):
    c = A.cues(spark, d)
    return quality.coverage(A.final(c), c).select("file_id", "pos", "state")


@query("CUES", "FINAL", sql="""WITH f AS (SELECT file_id, length(f.text) / length(c.text) AS ratio FROM final AS f JOIN (SELECT DISTINCT ON (file_id, start_ms, end_ms) * FROM cues) AS c USING (file_id, start_ms, end_ms) WHERE NOT starts_with(f.text, '[未翻译]'))
SELECT file_id, count(*) AS rows, list_sort(list(ratio))[count(*) // 2 + 1] AS median_ratio, avg((ratio < 0.3)::INT) AS low_share FROM f GROUP BY file_id""")
def length_ratio(spark, d):
    c = A.cues(spark, d)
    return quality.length_ratio(A.final(c), c)


@query("CUES", "FINAL", sql="""WITH s AS (SELECT DISTINCT file_id, start_ms, end_ms FROM cues) SELECT f.file_id, count(*) AS rows, count(s.start_ms) AS aligned, count(s.start_ms) / count(*) AS rate
FROM (SELECT file_id, start_ms + (pos % 9 = 0)::INT AS start_ms, end_ms FROM final) AS f LEFT JOIN s USING (file_id, start_ms, end_ms) GROUP BY f.file_id""")
def alignment_rate(spark, d):
    c = A.cues(spark, d)
    f = A.final(c).withColumn("start_ms", F.col("start_ms") + (F.col("pos") % 9 == 0).cast("int"))
    return quality.alignment(f, c)


@query("CUES", "FINAL", sql="SELECT file_id, count(*) AS rows, count(*) FILTER (starts_with(text, '[未翻译]')) AS untranslated, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (regexp_full_match(trim(text), '[-—–]+')) AS dashes FROM final GROUP BY file_id")
def placeholder_stats(spark, d):
    return quality.placeholder_stats(A.final(A.cues(spark, d)))


@query("CUES", "FINAL", sql="""WITH s AS (SELECT c.file_id, CASE WHEN f.pos IS NULL THEN 'missing' WHEN starts_with(f.text, '[未翻译]') THEN 'untranslated' WHEN length(f.text) <> 7 THEN 'translated' END AS s FROM cues AS c LEFT JOIN final AS f USING (file_id, pos)),
t AS (SELECT file_id, count(*) AS n, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'untranslated') AS untranslated, count(*) FILTER (s = 'translated') AS translated FROM s GROUP BY file_id)
SELECT *, n = missing + untranslated + translated AS balanced FROM t""")
def identity_check(spark, d):
    """Rows of seven characters are left out on purpose: their files don't balance."""
    c = A.cues(spark, d)
    f = A.final(c)
    lost = c.join(f.select("file_id", "pos"), ["file_id", "pos"], "left_anti")
    u = T.is_untranslated(F.col("text"))
    return quality.identity(c, missing=lost, untranslated=f.filter(u), translated=f.filter(~u & (F.length("text") != 7)))


@query("CUES", "FINAL", sql=r"""
WITH k AS (SELECT *, length(regexp_replace(text, '\s', '', 'g')) AS n, (end_ms - start_ms) / 1000 AS sec FROM final),
q AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n / sec DESC, pos) AS rank FROM k WHERE sec >= 0.5 AND n > 0 AND n / sec > 23),
w AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, pos) AS o FROM cues),
g AS (SELECT a.file_id, a.idx, a.start_ms - b.end_ms AS gap FROM w AS a JOIN w AS b ON a.file_id = b.file_id AND a.o = b.o + 1 WHERE a.start_ms - b.end_ms > 1700),
i AS (SELECT file_id, idx, 'untranslated' AS category, 'left untranslated' AS message, 'open' AS status, text AS own, NULL AS ex FROM k WHERE starts_with(text, '[未翻译]')
  UNION ALL SELECT file_id, idx, 'single_line_too_long', 'line of ' || n, 'open', NULL, substr(text, 1, 60) FROM k WHERE n > 30
  UNION ALL SELECT file_id, idx, 'cps_too_fast', 'rank ' || rank, 'open', NULL, '' FROM q WHERE rank <= 20
  UNION ALL SELECT file_id, idx, 'digits', 'digits in it', 'open', NULL, NULL FROM cues WHERE regexp_matches(text, '[0-9]{3}')
  UNION ALL SELECT file_id, idx, 'suspected_missed_speech', 'gap of ' || gap, 'observation', NULL, '' FROM g)
SELECT i.file_id, i.idx, category, message, status, CASE WHEN status = 'open' THEN coalesce(own, f.text) END AS current_text, coalesce(ex, substr(c.text, 1, 40), '') AS source_excerpt,
  row_number() OVER (PARTITION BY i.file_id ORDER BY i.idx, category, message) AS place FROM i LEFT JOIN final AS f USING (file_id, idx) LEFT JOIN cues AS c USING (file_id, idx)""")
def guide_items(spark, d):
    return guide(spark, d).select("file_id", "idx", "category", "message", "status", "current_text", "source_excerpt", "place")


def guide(spark, d):
    """Guide items from all five sources."""
    c = A.cues(spark, d, by_file=True)
    warnings = c.filter("text rlike '[0-9]{3}'").select("file_id", "idx", "timing", F.lit("digits").alias("category"), F.lit("digits in it").alias("message"))
    missed = quality.gap_observations(c, 1.7).select("file_id", "idx", "timing", F.concat(F.lit("gap of "), F.col("gap_ms").cast("string")).alias("message"))
    return quality.guide_items(A.final(c), c, warnings, missed)


@query("CUES", "PASS2", sql="""WITH a AS (SELECT file_id, start_ms, end_ms, min(text) AS a FROM cues GROUP BY ALL), b AS (SELECT file_id, start_ms, end_ms, min(text) AS b FROM pass2 GROUP BY ALL)
SELECT file_id, start_ms, end_ms, CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' WHEN a = b THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (file_id, start_ms, end_ms)""")
def output_diff(spark, d):
    c = A.cues(spark, d)
    return compare.output_diff(c, A.second_pass(c)).select("file_id", "start_ms", "end_ms", "status")


@query("CUES", "PASS2", sql="SELECT file_id, count(*) AS rows, avg((a.start_ms = b.start_ms)::DOUBLE) AS same_start, avg((a.text = b.text)::DOUBLE) AS same_text FROM cues AS a JOIN pass2 AS b USING (file_id, pos) GROUP BY file_id")
def positional_diff(spark, d):
    c = A.cues(spark, d)
    return compare.positional_agreement(c, A.second_pass(c))


@query("CUES", "PASS2", sql="""WITH m AS (SELECT *, max(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pass2 WHERE end_ms > start_ms),
i AS (SELECT *, sum(coalesce(start_ms > reach, true)::INT) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM m),
s AS (SELECT file_id, k, max(end_ms) - min(start_ms) AS ms FROM i GROUP BY ALL) SELECT file_id, sum(ms)::BIGINT AS speech_ms, count(*) AS spans FROM s GROUP BY file_id""")
def speech_union(spark, d):
    return compare.speech_union(A.second_pass(A.cues(spark, d)))


@query("CUES", sql=r"""WITH d AS (SELECT *, coalesce(text = lag(text) OVER (PARTITION BY file_id ORDER BY pos), false) AS dup FROM cues)
SELECT file_id, count(*) AS rows, avg((length(trim(text)) <= 3)::DOUBLE) AS fragment_ratio, count(*) FILTER (dup) AS duplicate_pairs,
  count(*) FILTER (len(list_filter(range(1, length(text) - 2), lambda i: text[i] = text[i + 1] AND text[i] = text[i + 2] AND text[i] = text[i + 3])) > 0) AS repeated, 0 + count(*) FILTER (length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) >= 8
    AND NOT regexp_matches(text, '[\x{4e00}-\x{9fff}]') AND len(regexp_extract_all(text, '[\x{3040}-\x{30ff}]')) > 0.95 * length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))) AS kana_only, count(*) FILTER (regexp_matches(text, 'sch|tion')) AS clusters FROM d GROUP BY file_id""")
def version_measures(spark, d):
    return compare.version_measures(A.cues(spark, d), {"clusters": "sch|tion"})


@query()
def side_by_side(spark, d):
    c = A.cues(spark, d)
    return compare.side_by_side(c, A.second_pass(c))


@query(sql="""SELECT file_id, string_agg(p, ',' ORDER BY k) AS reasons FROM (
  SELECT doc_id AS file_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN n_chars % 2 = 1 THEN 'input_fp' END AS p, 1 AS k FROM documents
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN 'config_fp' END, 2 FROM documents) GROUP BY file_id""")
def changed_inputs(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "n_chars")
    p = lambda c: c.cast("string")
    now = docs.select("file_id", p(F.col("n_chars")).alias("input_fp"), F.lit("c2").alias("config_fp"), F.lit("g").alias("glossary_fp"), F.lit("t").alias("tm_fp"))
    old = docs.filter("file_id % 7 <> 0").select("file_id", p(F.col("n_chars") - F.col("n_chars") % 2).alias("input_fp"), F.when(F.col("file_id") % 5 == 0, "c1").otherwise("c2").alias("config_fp"), F.lit("g").alias("glossary_fp"), F.lit("t").alias("tm_fp"), F.lit(2).alias("seq"))
    first = old.withColumns({"input_fp": F.lit("0"), "seq": F.lit(1)})
    rows = compare.changed_inputs(now, old.unionByName(first))
    return rows.select("file_id", F.when(F.size("reasons") > 0, F.array_join("reasons", ",")).alias("reasons"))


@query(sql="""WITH g AS (SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'mid' ELSE 'long' END AS t, CASE WHEN len(string_split(text, ' ')) < 80 THEN 'short' WHEN len(string_split(text, ' ')) < 330 THEN 'mid' ELSE 'long' END AS p FROM documents),
c AS (SELECT class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (t <> class AND p = class) AS fp, count(*) FILTER (t = class AND p <> class) AS fn FROM g, (SELECT unnest(['short', 'mid', 'long', 'none']) AS class) GROUP BY class),
r AS (SELECT class, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM c)
SELECT *, avg(precision) OVER () AS macro_precision, avg(recall) OVER () AS macro_recall FROM r""")
def confusion(spark, d):
    docs = A.table(spark, d, "documents")
    words = F.size(F.split("text", " "))
    cut = lambda c, a, b: F.when(c < a, "short").when(c < b, "mid").otherwise("long")
    rows = docs.select(cut(F.col("n_chars"), 500, 2000).alias("t"), cut(words, 80, 330).alias("p"))
    return compare.confusion(rows, "t", "p", ["short", "mid", "long", "none"])


# -- audio -----------------------------------------------------------------------------------------------

_SEG = """
WITH rk AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rms, hop_no) - 1 AS k, count(*) OVER (PARTITION BY file_id) - 1 AS last FROM hops),
th AS (SELECT file_id, rms AS threshold FROM rk WHERE k = round_even(last * 0.85::DOUBLE, 0)),
ld AS (SELECT h.file_id, hop_no, hop_no - row_number() OVER (PARTITION BY h.file_id ORDER BY hop_no) AS run FROM hops AS h JOIN th USING (file_id) WHERE rms > threshold),
sg AS (SELECT file_id, min(hop_no) * 10 AS start_ms, (max(hop_no) + 1) * 10 AS end_ms FROM ld GROUP BY file_id, run)
"""


@query("CUES", "HOPS", sql=_SEG + "SELECT * FROM sg")
def speech_segments(spark, d):
    return audio.series_segments(A.series(A.cues(spark, d))).select("file_id", "start_ms", "end_ms")


@query("CUES", "HOPS", sql=_SEG + ", t AS (SELECT file_id, count(*) * 10 AS ms FROM hops GROUP BY file_id) SELECT file_id, sum(end_ms - start_ms)::BIGINT AS speech_ms, round_even(100 * sum(end_ms - start_ms) / min(ms), 1) AS speech_pct FROM sg JOIN t USING (file_id) GROUP BY file_id")
def speech_ratio(spark, d):
    return audio.series_ratio(audio.series_segments(A.series(A.cues(spark, d))))


@query("CUES", "HOPS", sql=_SEG + """, g AS (SELECT file_id, idx, lag(end_ms) OVER w AS gs, start_ms AS ge FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, end_ms, pos)),
o AS (SELECT g.file_id, idx, gs, ge - gs AS gap_ms, sum(least(ge, end_ms) - greatest(gs, start_ms))::BIGINT AS speech_ms FROM g JOIN sg ON g.file_id = sg.file_id AND sg.start_ms < ge AND gs < sg.end_ms WHERE ge - gs >= 300 GROUP BY ALL)
SELECT file_id, idx, gap_ms, speech_ms FROM o QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY gs, idx) <= 20""")
def speech_in_gaps(spark, d):
    c = A.cues(spark, d)
    return audio.speech_in_gaps(c, audio.series_segments(A.series(c)).drop("total_ms")).select("file_id", "idx", "gap_ms", "speech_ms")


# -- requests and review ---------------------------------------------------------------------------------------

@query("CUES", sql="""WITH s AS (SELECT *, coalesce(start_ms - lag(start_ms) OVER w > 9000, false) AS b FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
n AS (SELECT *, sum(b::INT) OVER (PARTITION BY file_id ORDER BY pos)::BIGINT AS scene FROM s) SELECT file_id, pos, scene, ((row_number() OVER (PARTITION BY file_id, scene ORDER BY pos) - 1) // 20)::INT AS batch FROM n""")
def request_batches(spark, d):
    return assemble.batches(A.cues(spark, d), gap_ms=9000).select("file_id", "pos", "scene", "batch")


@query("CUES", sql="SELECT file_id, idx, upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS text FROM cues WHERE idx % 6 <> 4 AND trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) <> ''".replace("AS text FROM", "AS t0 FROM").replace("SELECT file_id, idx, upper", "SELECT file_id, idx, trim(t0) AS text FROM (SELECT file_id, idx, upper") + ")")
def parse_replies(spark, d):
    """Replies in the numbered form, written out from cues (some without the mark, some missing) and parsed again."""
    c = assemble.batches(A.cues(spark, d)).withColumn("t", F.upper(F.regexp_replace("text", "[^A-Za-z ]", "")))
    said = F.when(F.col("idx") % 6 != 4, F.when(F.col("idx") % 5 == 0, F.concat(F.lit("#"), F.col("idx").cast("string"), F.lit("\n"), "t")).otherwise(F.concat(F.lit("#"), F.col("idx").cast("string"), F.lit("\nTranslation> \n"), "t", F.lit("\n"))))
    bodies = c.withColumn("said", said).groupBy("file_id", "scene", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "said"))), lambda x: F.coalesce(x["said"], F.lit("ok"))), "\n").alias("body"), F.collect_list(F.col("idx").cast("int")).alias("expected"))
    bodies = bodies.withColumn("batch_id", F.col("scene") * 1000 + F.col("batch"))
    bodies = bodies.withColumn("body", F.regexp_replace("body", "\nok", "")).withColumn("body", F.regexp_replace("body", "^ok\n", ""))
    return assemble.parse_numbered(bodies).filter("text <> ''").select("file_id", "idx", "text")


@query("CUES", "MEMORY", sql=r"""WITH h AS (SELECT file_id, pos, idx, text, substr(sha256(trim(regexp_replace(text, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))), 1, 32) AS content_hash FROM cues)
SELECT file_id, idx, coalesce(target_text, CASE WHEN pos % 4 <> 1 THEN reverse(text) END, '[未翻译] ' || text) AS out, CASE WHEN target_text IS NOT NULL THEN 'memory' WHEN pos % 4 <> 1 THEN 'reply' ELSE 'source' END AS origin
FROM h LEFT JOIN (FROM tm WHERE stage = 1) USING (content_hash)""")
def stage_assembly(spark, d):
    from cuelake.operators import memory

    c = A.cues(spark, d)
    hits = memory.lookup_exact(c.withColumn("stage", F.lit(1)), A.memory(spark, d)).filter("target_text is not null").select("file_id", "idx", "target_text")
    replies = c.filter("pos % 4 <> 1").select("file_id", "idx", F.reverse("text").alias("text"))
    return assemble.assemble(c, hits, replies).select("file_id", "idx", "out", "origin")


@query("CUES", sql="""WITH k AS (SELECT *, length(trim(text)) AS ch FROM cues), t AS (SELECT *, sum(ch) OVER f AS total, count(*) OVER f AS n, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, pos) - 1 AS i FROM k WINDOW f AS (PARTITION BY file_id)),
b AS (SELECT *, CASE WHEN total <= 1500 THEN 1 ELSE greatest(3, least(8, ceil(total / 750))) END::BIGINT AS nb FROM t),
j AS (SELECT *, list_filter(range(nb), lambda q: i >= (q * n) // nb AND i < ((q + 1) * n) // nb)[1] AS bucket FROM b),
s AS (SELECT *, sum(ch + 1) OVER (PARTITION BY file_id, bucket ORDER BY start_ms, pos) AS spent FROM j) SELECT file_id, pos, bucket FROM s WHERE nb = 1 OR spent <= 1500 / nb""")
def synopsis_sample(spark, d):
    return assemble.synopsis_sample(A.cues(spark, d), 1500).select("file_id", "pos", "bucket")


@query("CUES", sql="WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS place FROM cues WHERE length(text) > 40) SELECT file_id, pos, place FROM r ORDER BY place, file_id LIMIT 500")
def round_robin_sample(spark, d):
    return review.round_robin(A.cues(spark, d).filter("length(text) > 40"), 500).select("file_id", "pos", "place")


@query("CUES", sql="""WITH e AS (SELECT file_id, pos, start_ms, length(text) AS n, pos % 7 AS cat, start_ms + CASE WHEN pos % 3 = 0 THEN 500 WHEN pos % 3 = 1 THEN 900000 ELSE NULL END AS cited FROM cues WHERE length(text) > 30),
v AS (SELECT *, n % 2 = 1 AND cat BETWEEN 1 AND 5 AS given FROM e)
SELECT file_id AS batch, pos::INT AS row, CASE WHEN given THEN cat ELSE 4 END AS category, NOT given AS filled, CASE WHEN NOT given THEN 'low' WHEN cat = 1 AND NOT ok THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN NOT given OR cat <> 1 THEN 'N/A' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verify
FROM (SELECT *, cited IS NOT NULL AND EXISTS (FROM cues AS c WHERE c.file_id = v.file_id AND c.pos BETWEEN v.pos - 5 AND v.pos + 5 AND abs(c.start_ms - v.cited) <= 1000) AS ok FROM v)""")
def verdict_check(spark, d):
    """Verdicts written as fenced JSON replies, parsed, filled and checked against the rows around them."""
    from cuelake.functions.timecode import format_ms

    c = A.cues(spark, d, by_file=True)
    e = c.filter("length(text) > 30").withColumn("at", F.when(F.col("pos") % 3 == 0, F.col("start_ms") + 500).when(F.col("pos") % 3 == 1, F.col("start_ms") + 900_000))
    one = F.to_json(F.struct(F.col("pos").alias("row"), (F.col("pos") % 7).alias("category"), F.lit("pass1").alias("side"), F.lit("high").alias("confidence"), F.coalesce(format_ms(F.col("at")), F.lit("")).alias("evidence_timing"), F.lit("pass1").alias("evidence_pass"), F.lit("fits").alias("reason")))
    replies = e.withColumn("one", one).groupBy(F.col("file_id").alias("batch")).agg(F.concat(F.lit("Here:\n```json\n["), F.array_join(F.collect_list(F.when(F.length("text") % 2 == 1, F.col("one"))), ",\n"), F.lit("]\n```")).alias("body"))
    rows = review.verdicts(replies, e.select(F.col("file_id").alias("batch"), F.col("pos").alias("row")))
    around = neighbours(rows.withColumnRenamed("batch", "file_id"), c, "row", 5, "start_ms", "text").withColumnRenamed("file_id", "batch")  # eleven rows
    return review.verify_evidence(around).select("batch", "row", "category", "filled", "confidence", "verify")
