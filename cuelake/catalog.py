"""Queries over the given tables, one per operator, and the DuckDB SQL of those that SQL expresses."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.timecode import parse_timing
from cuelake.operators import gate, glossary, memory, quality, search
from cuelake.plans.versions import settled
from cuelake.registry import ORACLES, QUERIES, query
from cuelake.sources import adapters as A

#: Rules for the given tables, whose texts are invented words in Latin script.
LATIN_GATE = gate.GateRules(keep=("OK", "The", "and"), isolated=("Of", "On", "In", "Un", "Es"), meta=("MIT",), meta_latin=("license", "all rights"), exclamation_run=2)


# -- parsing, speech rate, gaps ------------------------------------------------------------------------

@query("CUES", sql="SELECT file_id, pos, idx, start_ms, end_ms, text FROM cues")
def cue_parse(spark, d):
    c = A.cues(spark, d)
    t = parse_timing(F.col("timing"))
    return c.select("file_id", "pos", "idx", t["start_ms"].alias("start_ms"), t["end_ms"].alias("end_ms"), "text")


_CPS = r"""
WITH k AS (SELECT *, length(regexp_replace(text, '\s', '', 'g')) AS chars, (end_ms - start_ms) / 1000 AS seconds FROM cues),
r AS (SELECT *, CASE WHEN chars > 0 AND seconds >= 0.5 THEN chars / seconds END AS cps FROM k)
"""


@query("CUES", sql=_CPS + """SELECT lang, count(cps) AS n, avg(cps) AS mean_cps, quantile_disc(cps, 0.5) AS p50, quantile_disc(cps, 0.9) AS p90, quantile_disc(cps, 0.95) AS p95, max(cps) AS max_cps,
  count(*) FILTER (cps IS NULL) AS skipped, count(*) FILTER (cps > 23) AS over_limit FROM r GROUP BY ROLLUP (lang)""")
def cue_cps_distribution(spark, d):
    return quality.cps_distribution(A.cues(spark, d))


@query("CUES", sql=_CPS + "SELECT file_id, idx, chars, round(cps, 6) AS cps, 23.0::DOUBLE AS cps_limit FROM r WHERE cps > 23")
def cue_cps_observations(spark, d):
    return quality.cps_observations(A.cues(spark, d)).select("file_id", "idx", "chars", F.round("cps", 6).alias("cps"), "cps_limit")


@query("CUES", sql=_CPS + """, q AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cps DESC, pos) AS rank, count(*) OVER (PARTITION BY file_id) > 20 AS truncated FROM r WHERE cps > 20)
SELECT file_id, idx, round(cps, 6) AS cps, rank, truncated FROM q WHERE rank <= 20""")
def cue_cps_actions(spark, d):
    return quality.cps_actions(A.cues(spark, d), 20.0, cjk_only=False).select("file_id", "idx", F.round("cps", 6).alias("cps"), "rank", "truncated")


@query("CUES", sql="""WITH g AS (SELECT file_id, idx, start_ms - lag(end_ms) OVER w AS gap_ms, lag(idx) OVER w AS prev_idx FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, end_ms, pos)),
m AS (SELECT *, max(gap_ms) OVER (PARTITION BY file_id) AS max_gap_ms FROM g) SELECT * FROM m WHERE gap_ms > 1500""")
def cue_gaps(spark, d):
    return quality.gap_observations(A.cues(spark, d), 1.5).select("file_id", "idx", "gap_ms", "prev_idx", "max_gap_ms")


@query("CUES", sql="SELECT file_id, idx, greatest(start_ms, coalesce(lag(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, pos), start_ms)) AS new_start_ms, end_ms FROM cues")
def overlap_repair(spark, d):
    return quality.overlap_repair(A.cues(spark, d)).select("file_id", "idx", "new_start_ms", "end_ms")


@query("CUES", sql=r"""WITH k AS (SELECT file_id, idx, length(regexp_replace(text, '\s', '', 'g')) AS n, text FROM cues) SELECT file_id, idx, n AS max_len, substr(text, 1, 60) AS excerpt FROM k WHERE n > 30""")
def long_lines(spark, d):
    return quality.long_lines(A.cues(spark, d)).select("file_id", "idx", "max_len", "excerpt")


@query("CUES", sql=r"""WITH k AS (SELECT file_id, idx, length(regexp_replace(text, '\s', '', 'g')) AS n FROM cues WHERE NOT contains(text, 'the ')) SELECT file_id, idx, n AS max_len FROM k WHERE n > 30""")
def long_lines_whitelist(spark, d):
    """Rows that a project's list lets be long are left out."""
    return quality.long_lines(A.cues(spark, d), whitelist=F.contains("text", F.lit("the "))).select("file_id", "idx", "max_len")


@query(sql=r"""SELECT page_id, k.i AS line_no, len(regexp_extract_all(k.l, '<[^>]+>')) AS tags, trim(regexp_replace(k.l, '<[^>]+>', '', 'g')) AS text
FROM pages, (SELECT unnest(range(len(string_split(html, chr(10))))) AS i, unnest(string_split(html, chr(10))) AS l) AS k""")
def tag_strip(spark, d):
    rows = A.table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line_no", "l"))
    return rows.select("page_id", "line_no", T.tag_count(F.col("l")).alias("tags"), F.trim(T.strip_tags(F.col("l"))).alias("text"))


# -- the gate ---------------------------------------------------------------------------------------

_GATE = r"""
WITH g0 AS (SELECT *, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS norm FROM cues),
g1 AS (SELECT *, coalesce(norm <> lag(norm) OVER w, true) AS brk FROM g0 WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
g2 AS (SELECT *, sum(brk::INT) OVER (PARTITION BY file_id ORDER BY pos) AS run_id FROM g1),
g3 AS (SELECT *, count(*) OVER (PARTITION BY file_id, run_id) AS run, min(start_ms) OVER f AS lo, max(end_ms) OVER f AS hi FROM g2 WINDOW f AS (PARTITION BY file_id)),
g4 AS (SELECT *, norm IN ('OK', 'The', 'and') AS keep, CASE WHEN norm IN ('OK', 'The', 'and') THEN NULL
  WHEN regexp_matches(text, '[!！]{2,}') AND regexp_full_match(text, '(?:[!！?？.。…,，、;；:：\-—~～]|\s)+') THEN 'exclamation'
  WHEN text <> '' AND NOT regexp_matches(text, '[\p{L}\p{N}_]') THEN 'pure_punctuation'
  WHEN regexp_full_match(norm, '[A-Za-z]{2,}') AND NOT regexp_matches(lower(norm), '[aeiou]') AND norm <> upper(norm) THEN 'unpronounceable'
  WHEN length(norm) >= 2 AND run >= 4 THEN 'repeat_loop'
  WHEN regexp_matches(text, 'MIT') OR regexp_matches(lower(text), 'license|all rights') THEN CASE WHEN hi > lo AND start_ms >= lo + (hi - lo) * 0.9::DOUBLE THEN 'end_meta' WHEN norm IN ('Of', 'On', 'In', 'Un', 'Es') THEN 'isolated_response' END
  WHEN norm IN ('Of', 'On', 'In', 'Un', 'Es') THEN 'isolated_response' END AS category FROM g3),
g5 AS (SELECT *, coalesce(category IN ('exclamation', 'pure_punctuation', 'unpronounceable', 'repeat_loop', 'end_meta'), false) AS would FROM g4),
g6 AS (SELECT *, 100 * sum(would::INT) OVER f > 50 * count(*) OVER f AS valve_tripped FROM g5 WINDOW f AS (PARTITION BY file_id))
"""


def _gated(spark, d):
    return gate.classify(A.cues(spark, d), LATIN_GATE)


_TIGHT = _GATE.replace("count(*) OVER (PARTITION BY file_id, run_id) AS run,", "count(*) OVER (PARTITION BY file_id, run_id) AS run, bool_or(pos % 4 = 1) OVER (PARTITION BY file_id, run_id) AS run_tight,").replace(
    "run >= 4", "run >= CASE WHEN run_tight THEN 2 ELSE 4 END").replace("start_ms >= lo + (hi - lo) * 0.9::DOUBLE", "(start_ms >= lo + (hi - lo) * 0.9::DOUBLE OR (pos % 4 = 1 AND start_ms >= lo + (hi - lo) * 0.5::DOUBLE))")


@query("CUES", sql=_TIGHT + "SELECT file_id, pos, category, would AND NOT valve_tripped AS deleted FROM g6 WHERE category IS NOT NULL")
def gate_low_trust(spark, d):
    """Rows of little trust are judged by tighter limits; so is a run that holds one."""
    rules = dataclasses.replace(LATIN_GATE, tight={"repeat_run": 2, "window_ratio": 0.5})
    return gate.classify(A.cues(spark, d), rules, F.col("pos") % 4 == 1).filter("category is not null").select("file_id", "pos", "category", "deleted")


@query("CUES", sql=_GATE + "SELECT file_id, pos, category, would, valve_tripped, would AND NOT valve_tripped AS deleted FROM g6 WHERE category IS NOT NULL")
def gate_classify(spark, d):
    return _gated(spark, d).filter("category is not null").select("file_id", "pos", "category", "would", "valve_tripped", "deleted")


@query("CUES", sql=_GATE + "SELECT file_id, count(*) AS total, sum(would::INT)::BIGINT AS would, bool_or(valve_tripped) AS valve_tripped, count(*) FILTER (would AND NOT valve_tripped) AS deleted FROM g6 GROUP BY file_id")
def gate_valve(spark, d):
    return _gated(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("would").alias("would"), F.bool_or("valve_tripped").alias("valve_tripped"), F.count_if("deleted").alias("deleted"))


@query("CUES", sql=_GATE + "SELECT file_id, category, count(*) AS detected, count(*) FILTER (would AND NOT valve_tripped) AS deleted, bool_or(valve_tripped) AS valve_tripped FROM g6 WHERE category IS NOT NULL GROUP BY ALL")
def gate_report(spark, d):
    return gate.file_report(_gated(spark, d))


@query("CUES", sql=_GATE + """, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS place FROM g6 WHERE category IS NOT NULL),
c AS (SELECT file_id, category, count(*) AS n, count(*) FILTER (would AND NOT valve_tripped) AS del FROM k GROUP BY ALL),
m AS (SELECT file_id, string_agg(category || ':' || n || ':' || del, ',' ORDER BY category) AS categories FROM c GROUP BY ALL),
x AS (SELECT file_id, string_agg(pos || ':' || category || ':' || substr(text, 1, 60), '|' ORDER BY pos) AS samples FROM k WHERE place <= 50 GROUP BY ALL)
SELECT g.file_id, count(*) AS total, count(*) FILTER (would AND NOT valve_tripped) AS deleted, count(category) AS detected, bool_or(valve_tripped) AS valve_tripped, coalesce(any_value(categories), '') AS categories, coalesce(any_value(samples), '') AS samples
FROM g6 AS g LEFT JOIN m USING (file_id) LEFT JOIN x USING (file_id) GROUP BY g.file_id""")
def gate_summary(spark, d):
    """A row per file, its classes as class:detected:deleted and its first fifty detected rows."""
    rows = gate.gate_summary(_gated(spark, d))
    classes = F.transform(F.array_sort(F.map_keys("categories")), lambda c: F.concat_ws(":", c, F.col("categories")[c]["detected"], F.col("categories")[c]["deleted"]))
    shown = F.transform("samples", lambda x: F.concat_ws(":", x["pos"], x["category"], x["text"]))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return rows.select("file_id", "total", "deleted", "detected", "valve_tripped", text(classes).alias("categories"), F.array_join(shown, "|").alias("samples"))


@query("CUES", sql=_GATE + "SELECT file_id, run_id, min(pos) AS first_pos, count(*) AS rows, min(norm) AS norm FROM g3 WHERE run >= 2 GROUP BY file_id, run_id")
def gate_repeat_islands(spark, d):
    rows = gate.with_predicates(A.cues(spark, d), LATIN_GATE).filter("run >= 2")
    return rows.groupBy("file_id", "run_id").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("rows"), F.min("norm").alias("norm"))


@query("RUN_EVENTS", "TELEMETRY", sql="SELECT file_id, count(*) AS scenes, count(*) FILTER (NOT produced_output OR coalesce(max_no_speech_prob > 0.6 AND mean_avg_logprob < -1.0, false)) AS low_trust FROM telemetry GROUP BY file_id")
def low_trust_scenes(spark, d):
    scenes = A.telemetry(spark, d)
    return scenes.groupBy("file_id").agg(F.count(F.lit(1)).alias("scenes"), F.count_if(gate.scene_low_trust(scenes.columns)).alias("low_trust"))


# -- translation memory -----------------------------------------------------------------------------

_HASHED = r"""hashed AS (SELECT file_id, pos, text, substr(sha256(trim(regexp_replace(text, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))), 1, 32) AS content_hash, (pos % 2 + 1)::INT AS stage FROM cues)"""


@query("CUES", "MEMORY", sql=f"WITH {_HASHED} SELECT file_id, pos, h.stage, id, target_text FROM hashed AS h LEFT JOIN tm USING (content_hash, stage)")
def tm_exact(spark, d):
    q = A.cues(spark, d).select("file_id", "pos", "text", (F.col("pos") % 2 + 1).cast("int").alias("stage"))
    return memory.lookup_exact(q, A.memory(spark, d)).select("file_id", "pos", "stage", "id", "target_text")


@query("CUES", "MEMORY", sql="SELECT stage, count(*) AS entries, sum(hit_count)::BIGINT AS hits FROM tm GROUP BY ROLLUP (stage)")
def tm_stats_rollup(spark, d):
    return memory.stats(A.memory(spark, d))


@query("CUES", "MEMORY", sql="""WITH w AS (SELECT days, source_name, count(*) AS n FROM tm, (SELECT unnest([7, 30, 36500]) AS days) WHERE created_at >= TIMESTAMP '2024-03-01' - to_days(days) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY days ORDER BY n DESC, source_name) AS k FROM w)
SELECT days, least(k, 6)::INT AS rank, CASE WHEN k <= 5 THEN source_name ELSE 'other' END AS source, sum(n)::BIGINT AS n, count(*) AS sources FROM r GROUP BY ALL""")
def tm_window_summary(spark, d):
    return memory.window_summary(A.memory(spark, d), F.lit("2024-03-01 00:00:00").cast("timestamp"))


@query("CUES", "MEMORY", sql=rf"""WITH {_HASHED}
SELECT file_id, pos, coalesce((SELECT string_agg(tm.stage || ':' || tm.target_text, '|' ORDER BY tm.stage) FROM tm WHERE tm.content_hash = h.content_hash), '') AS targets FROM hashed AS h""")
def tm_all_stages(spark, d):
    q = memory.lookup_stages(A.cues(spark, d).select("file_id", "pos", "text"), A.memory(spark, d))
    return q.select("file_id", "pos", F.array_join(F.transform(F.map_entries("targets"), lambda e: F.concat_ws(":", e["key"], e["value"])), "|").alias("targets"))


@query("CUES", "MEMORY", sql=f"WITH {_HASHED} SELECT file_id, pos FROM hashed AS h WHERE EXISTS (FROM tm WHERE tm.content_hash = h.content_hash AND tm.stage = h.stage)")
def tm_known(spark, d):
    q = A.cues(spark, d).select("file_id", "pos", "text", (F.col("pos") % 2 + 1).cast("int").alias("stage"))
    return memory.known(q, A.memory(spark, d)).select("file_id", "pos")


@query("CUES", "MEMORY", sql=f"WITH {_HASHED} SELECT id, hit_count + (EXISTS (FROM hashed AS h WHERE tm.content_hash = h.content_hash AND tm.stage = h.stage))::INT AS hit_count FROM tm")
def tm_hit_counts(spark, d):
    tm = A.memory(spark, d)
    q = A.cues(spark, d).select("file_id", "pos", "text", (F.col("pos") % 2 + 1).cast("int").alias("stage"))
    return memory.count_hits(tm, memory.lookup_exact(q, tm).filter("id is not null")).select("id", "hit_count")


@query("CUES", "MEMORY", sql="SELECT id FROM tm WHERE stage <> 2")
def tm_clear(spark, d):
    return memory.clear(A.memory(spark, d), 2).select("id")


@query("CUES", "MEMORY", "PAIRS", sql=r"""
WITH b0 AS (SELECT trim(regexp_replace(source_text, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS source_text, trim(regexp_replace(target_text, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS target_text, 1 AS stage, created_at, source_name, conv_id * 1000 + turn AS ord FROM pairs
  UNION ALL SELECT source_text, trim(reverse(target_text)), stage, TIMESTAMP '2025-01-01', NULL, id FROM tm WHERE id % 5 = 0),
b AS (SELECT substr(sha256(source_text), 1, 32) AS content_hash, stage, arg_max(source_text, ord) AS source_text, arg_max(target_text, ord) AS target_text, arg_min(created_at, ord) AS created_at, arg_max(source_name, ord) FILTER (source_name IS NOT NULL) AS source_name
  FROM b0 WHERE source_text <> '' AND target_text <> '' GROUP BY 1, 2)
SELECT coalesce(tm.id, (SELECT max(id) FROM tm) + row_number() OVER (PARTITION BY tm.id IS NULL ORDER BY content_hash, stage)) AS id, content_hash, stage, coalesce(b.source_text, tm.source_text) AS source_text, coalesce(b.target_text, tm.target_text) AS target_text,
  length(coalesce(b.source_text, tm.source_text)) AS char_count, coalesce(tm.created_at, b.created_at) AS created_at, coalesce(tm.hit_count, 0) AS hit_count, coalesce(b.source_name, tm.source_name) AS source_name, 'ja' AS source_lang, 'zh' AS target_lang
FROM tm FULL JOIN b USING (content_hash, stage)""")
def tm_upsert(spark, d):
    tm = settled(A.memory(spark, d))
    new = A.pairs(spark, d).select(F.lit(1).alias("stage"), "source_text", "target_text", "created_at", "source_name", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    again = tm.filter("id % 5 = 0").select("stage", "source_text", F.reverse("target_text").alias("target_text"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("source_name"), F.col("id").alias("ord"))
    return memory.upsert(tm, new.unionByName(again))


@query("CUES", "MEMORY", sql="""WITH e AS (SELECT *, CASE WHEN id % 2 = 0 THEN content_hash ELSE reverse(content_hash) END AS h FROM tm)
SELECT e.id, EXISTS (FROM tm WHERE tm.content_hash = e.h AND tm.stage = e.stage) AS skipped FROM e""")
def tm_promote(spark, d):
    tm = A.memory(spark, d)
    entries = tm.withColumn("content_hash", F.when(F.col("id") % 2 == 0, F.col("content_hash")).otherwise(F.reverse("content_hash")))
    new, skipped = memory.promote(tm, entries)
    return new.select("id", F.lit(False).alias("skipped")).union(skipped.select("id", F.lit(True)))


@query("CUES", "MEMORY", sql="""WITH e AS (SELECT *, CASE WHEN id % 2 = 0 THEN content_hash ELSE reverse(content_hash) END AS h FROM tm)
SELECT id, content_hash FROM tm UNION ALL SELECT id, h FROM e WHERE NOT EXISTS (FROM tm WHERE tm.content_hash = e.h AND tm.stage = e.stage)""")
def tm_promoted(spark, d):
    from cuelake.catalog_files import folder

    tm = A.memory(spark, d)
    entries = tm.withColumn("content_hash", F.when(F.col("id") % 2 == 0, F.col("content_hash")).otherwise(F.reverse("content_hash")))
    return memory.promoted(tm, entries, folder(spark, "backup")).select("id", "content_hash")


_FOLD = r"trim(regexp_replace({}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_MATCH = r"trim(regexp_replace(regexp_replace({}, '[\p{{P}}…⋯‥~〜～·]', '', 'g'), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_PURGE = f"""
WITH next AS (SELECT *, lead(text) OVER (PARTITION BY file_id ORDER BY pos) AS after FROM cues),
c0 AS (SELECT trim(CASE lang WHEN 'en' THEN text WHEN 'de' THEN '  ' || text ELSE '«' || text || '»!' END) AS text, 'src' || (file_id % 8) AS name, 'raw' AS form FROM cues
  UNION SELECT trim(text || after), 'src' || (file_id % 8), 'premerge' FROM next WHERE length(text) < 12 AND after IS NOT NULL),
c AS (SELECT *, substr(sha256({_FOLD.format('text')}), 1, 32) AS h, {_MATCH.format('text')} AS norm FROM c0 WHERE text <> ''),
t AS (SELECT id, stage, content_hash AS h, source_name, {_MATCH.format('source_text')} AS norm, CASE WHEN id % 50 <> 0 THEN created_at END AS created_at FROM tm),
p AS (SELECT *, CASE WHEN h IN (SELECT h FROM c WHERE form = 'raw') THEN 'raw' WHEN h IN (SELECT h FROM c WHERE form = 'premerge') THEN 'premerge' WHEN norm IN (SELECT norm FROM c WHERE norm <> '') THEN 'normalized' END AS match,
  NOT EXISTS (FROM c WHERE c.h = t.h AND name = source_name) AND NOT EXISTS (FROM c WHERE c.norm = t.norm AND c.norm <> '' AND name = source_name) AS suspicious FROM t),
plan AS (SELECT id, stage, match, CASE WHEN id % 20 = 0 THEN 'would_keep_excluded' WHEN created_at IS NULL THEN 'would_keep_unknown_time' ELSE 'would_delete' END AS action, suspicious FROM p
  WHERE match IS NOT NULL AND (created_at IS NULL OR created_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-02-20'))
"""


def _purge(spark, d):
    from pyspark.sql import Window

    c = A.cues(spark, d).withColumns({"name": F.concat(F.lit("src"), (F.col("file_id") % 8).cast("string")), "after": F.lead("text").over(Window.partitionBy("file_id").orderBy("pos"))})
    asked = c.withColumn("text", F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", F.concat(F.lit("  "), "text")).otherwise(F.concat(F.lit("«"), "text", F.lit("»!"))))
    joined = c.filter("length(text) < 12 and after is not null").withColumn("text", F.concat("text", "after"))
    tm = settled(A.memory(spark, d).withColumn("created_at", F.when(F.col("id") % 50 != 0, F.col("created_at"))))
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp")
    return tm, memory.purge_plan(tm, memory.purge_candidates(asked, joined), at("2024-01-10"), at("2024-02-20"), exclude=tm.filter("id % 20 = 0"))


@query("CUES", "MEMORY", sql=_PURGE + "SELECT * FROM plan")
def tm_purge_plan(spark, d):
    return _purge(spark, d)[1]


@query("CUES", "MEMORY", sql=_PURGE + """, n AS (SELECT * FROM plan WHERE action = 'would_delete'),
d1 AS (SELECT match, id >> 16 AS k, sha256(string_agg(id::VARCHAR || chr(10), '' ORDER BY id)) AS d FROM n GROUP BY ALL), d2 AS (SELECT match, k >> 16 AS k2, sha256(string_agg(d, '' ORDER BY k)) AS d FROM d1 GROUP BY ALL),
d3 AS (SELECT match, k2 >> 16 AS k3, sha256(string_agg(d, '' ORDER BY k2)) AS d FROM d2 GROUP BY ALL), d4 AS (SELECT match, sha256(string_agg(d, '' ORDER BY k3)) AS d FROM d3 GROUP BY ALL)
SELECT match, count(*) AS rows, count(*) FILTER (suspicious) AS suspicious, min(d) AS sha256 FROM n JOIN d4 USING (match) GROUP BY match""")
def tm_purge_digest(spark, d):
    return memory.purge_digest(_purge(spark, d)[1])


@query("CUES", "MEMORY", sql=_PURGE + "SELECT id, stage FROM tm WHERE id NOT IN (SELECT id FROM plan WHERE action = 'would_delete')")
def tm_purged(spark, d):
    from cuelake.catalog_files import folder

    return memory.purged(*_purge(spark, d), folder(spark, "backup")).select("id", "stage")


@query("CUES", "MEMORY", "SENTENCES", sql=f"""
WITH qs AS (SELECT query_id, lower({_FOLD.format('text')}) AS text FROM sentences),
c AS (SELECT query_id, text, id, lower(source_text) AS source_text, hit_count FROM qs JOIN tm ON stage = 1 AND char_count BETWEEN greatest(1, floor(length(text) * 0.5)) AND greatest(1, floor(length(text) * 1.5)) WHERE text <> ''
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, id) <= 200),
j AS (SELECT *, list_distinct(string_split(text, '')) AS a, list_distinct(string_split(source_text, '')) AS b FROM c),
s AS (SELECT query_id, id, hit_count, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM j)
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, hit_count DESC, id) AS rank FROM s WHERE similarity >= 0.6
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, hit_count DESC, id) <= 10""")
def tm_fuzzy(spark, d):
    return memory.lookup_fuzzy(A.sentences(spark, d), A.memory(spark, d), 0.6)


@query("CUES", "MEMORY", "SENTENCES", sql=r"""
WITH t0 AS (SELECT id, regexp_extract_all(replace(lower(source_text || ' ' || target_text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS tk FROM tm),
p AS (SELECT id, len(tk) AS l, term, count(*) AS tf FROM t0, unnest(tk) AS u(term) GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM tm) AS docs, (SELECT avg(l) FROM (SELECT DISTINCT id, l FROM p)) AS avg_len),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')) AS term FROM sentences),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
h AS (SELECT query_id, id, count(*) AS n, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY query_id, id),
f AS (SELECT h.* FROM h WHERE n = (SELECT count(*) FROM q WHERE q.query_id = h.query_id))
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 20""")
def tm_search(spark, d):
    from cuelake.catalog_files import folder

    index = folder(spark, "index")
    search.create(spark, index)
    search.append(A.memory(spark, d).select("id", F.concat_ws(" ", "source_text", "target_text").alias("text")), index)
    return search.search(A.sentences(spark, d), index)


@query("CUES", "MEMORY", "SENTENCES", sql=f"""
WITH q AS (SELECT query_id, substr(sha256({_FOLD.format('text')}), 1, 32) AS h, {_MATCH.format('text')} AS norm, {_FOLD.format('text')} AS t FROM (SELECT query_id, text FROM sentences UNION ALL SELECT query_id || 'm', '(' || text || ')' FROM sentences UNION ALL SELECT query_id || 'p', substr(text, 3, 12) FROM sentences)),
m AS (SELECT *, {_MATCH.format('source_text')} AS norm FROM tm),
r AS (SELECT query_id, (SELECT min(id) FROM m WHERE m.content_hash = q.h) AS e, (SELECT min(id) FROM m WHERE m.norm = q.norm AND q.norm <> '') AS n, (SELECT min(id) FROM m WHERE contains(m.source_text, q.t) AND q.t <> '') AS l FROM q)
SELECT query_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN n IS NOT NULL THEN 'normalised' ELSE 'like' END AS match, coalesce(e, n, l) AS id FROM r WHERE coalesce(e, n, l) IS NOT NULL""")
def tm_probe(spark, d):
    q = A.sentences(spark, d).select("query_id", "text")
    more = q.select(F.concat("query_id", F.lit("m")).alias("query_id"), F.concat(F.lit("("), "text", F.lit(")")).alias("text")).union(q.select(F.concat("query_id", F.lit("p")), F.substring("text", 3, 12)))
    return memory.probe(q.union(more), settled(A.memory(spark, d).select("id", "content_hash", "source_text")))


# -- glossary ---------------------------------------------------------------------------------------

_HITS = r"""
WITH al AS (SELECT f.file_id, f.pos, f.text, c.text AS src_text FROM final AS f JOIN cues AS c USING (file_id, pos)),
w AS (SELECT DISTINCT file_id, pos, text, unnest(regexp_extract_all(lower(src_text), '[A-Za-z0-9_\x{c0}-\x{24f}]+')) AS t FROM al),
hit AS (SELECT file_id, pos, src, CASE WHEN contains(text, dst) THEN 'main' WHEN ord % 2 = 0 AND contains(text, reverse(src)) THEN 'alias' ELSE 'neither' END AS verdict FROM w JOIN glossary ON t = src)
"""


def _conflicts(spark, d):
    c = A.cues(spark, d)
    return glossary.conflicts(A.final(c), c, A.glossary(spark, d))


@query("CUES", "FINAL", "GLOSSARY", sql=_HITS + "SELECT * FROM hit WHERE verdict <> 'main'")
def term_conflicts(spark, d):
    return _conflicts(spark, d).filter("verdict <> 'main'").select("file_id", "pos", "src", "verdict")


@query("CUES", "FINAL", "GLOSSARY", sql=_HITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY verdict <> 'neither', file_id, pos) AS k FROM hit) SELECT src, count(*) AS hits, count(*) FILTER (verdict = 'main') AS with_main, count(*) FILTER (verdict = 'alias') AS with_alias, count(*) FILTER (verdict = 'neither') AS with_neither, string_agg(file_id || ':' || pos, ',' ORDER BY file_id, pos) FILTER (verdict = 'neither' AND k <= 3) AS samples FROM r GROUP BY src")
def term_consistency(spark, d):
    rows = glossary.term_stats(_conflicts(spark, d))
    samples = F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x["file_id"], x["pos"])), ",")
    return rows.withColumn("samples", F.when(F.size("samples") > 0, samples))


_LAYERS = "WITH ll AS (SELECT src, dst, ord, ['override', 'user', 'learned'][ord % 3 + 1] AS layer FROM glossary UNION ALL SELECT src, lower(dst), ord + 100, 'learned' FROM glossary WHERE ord % 2 = 0)"


@query("GLOSSARY", sql=_LAYERS + """, r AS (SELECT *, list_position(['override', 'user', 'learned'], layer) AS lr, row_number() OVER (PARTITION BY src, layer ORDER BY ord) AS k FROM ll)
SELECT src, dst, layer, lr = min(lr) OVER (PARTITION BY src) AND (lr < 3 OR k = 1) AS kept FROM r""")
def glossary_precedence(spark, d):
    g = A.glossary(spark, d).select("src", "dst", "layer", "ord")
    more = g.filter("ord % 2 = 0").select("src", F.lower("dst").alias("dst"), F.lit("learned").alias("layer"), (F.col("ord") + 100).alias("ord"))
    return glossary.precedence(g.unionByName(more)).select("src", "dst", "layer", "kept")


@query("GLOSSARY", sql="""WITH a AS (SELECT CASE WHEN ord % 3 = 0 THEN upper(src) WHEN ord % 3 = 1 THEN src || 'x' ELSE src END AS src, CASE WHEN ord % 2 = 0 THEN dst ELSE lower(dst) END AS dst, ord FROM glossary
  UNION ALL SELECT src || 'x', dst, ord + 100 FROM glossary WHERE ord % 3 = 1),
f AS (SELECT *, first_value(dst) OVER w AS fd, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY lower(trim(src)) ORDER BY ord))
SELECT src, dst, ord, CASE WHEN EXISTS (FROM glossary AS g WHERE lower(g.src) = lower(f.src) AND g.dst = f.dst) THEN 'exists' WHEN EXISTS (FROM glossary AS g WHERE lower(g.src) = lower(f.src)) THEN 'exists_diff'
  WHEN k = 1 THEN 'added' WHEN fd = dst THEN 'exists' ELSE 'exists_diff' END AS status FROM f""")
def glossary_append(spark, d):
    g = A.glossary(spark, d)
    src = F.when(F.col("ord") % 3 == 0, F.upper("src")).when(F.col("ord") % 3 == 1, F.concat("src", F.lit("x"))).otherwise(F.col("src"))
    a = g.select(src.alias("src"), F.when(F.col("ord") % 2 == 0, F.col("dst")).otherwise(F.lower("dst")).alias("dst"), "ord")
    more = g.filter("ord % 3 = 1").select(F.concat("src", F.lit("x")).alias("src"), "dst", (F.col("ord") + 100).alias("ord"))
    return glossary.append(g, a.unionByName(more))


@query("GLOSSARY", sql="SELECT src, ord % 4 = 1 AS kept FROM glossary")
def glossary_reset(spark, d):
    g = A.glossary(spark, d)
    return glossary.reset(g, g.filter("ord % 4 = 1").select(F.upper("src").alias("src"))).select("src", "kept")


def watch_log(spark, d):
    """The given events as watch records: a record a day, candidates and conflicts by event type, some marked as false."""
    e = A.table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("value") > 150).alias("conflicts"), F.count_if(F.col("value") > 195).alias("wrong"))
    per = F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("candidates", "conflicts"))))
    wrong = F.map_from_entries(F.collect_list(F.when((F.col("event_type") == "error") & (F.col("wrong") > 0), F.struct("event_type", F.struct(F.col("wrong").alias("count"), F.when(F.col("candidates") % 2 == 0, "name").otherwise("word").alias("category"))))))
    return e.groupBy("date").agg(per.alias("per_term"), wrong.alias("manual_fp"))


_WATCH = """WITH e AS (SELECT ts::DATE AS day, event_type, count(*) AS c, count(*) FILTER (value > 150) AS x, count(*) FILTER (value > 195) AS w FROM events GROUP BY ALL)
"""


@query(sql=_WATCH + """, s AS (SELECT count(DISTINCT day) AS runs, sum(c)::BIGINT AS candidates, sum(x)::BIGINT AS conflicts, coalesce(sum(w) FILTER (event_type = 'error'), 0)::BIGINT AS false_positives, coalesce(sum(w) FILTER (event_type = 'error' AND c % 2 = 0), 0)::BIGINT AS protected FROM e),
r AS (SELECT *, CASE WHEN conflicts > 0 THEN false_positives / conflicts ELSE 0 END AS rate FROM s)
SELECT *, CASE WHEN runs >= 3 AND candidates < 100 THEN 'insufficient' WHEN (runs >= 3 OR candidates >= 300) AND rate < 0.02 AND protected = 0 THEN 'ready' ELSE 'not_ready' END AS advice FROM r""")
def watch_eval(spark, d):
    return glossary.evaluate_watch(watch_log(spark, d))


@query("CUES", sql=r"""WITH b AS (SELECT item_id, lower(text) AS t FROM benchmark), f AS (SELECT doc_id AS file_id, lower(text) AS t FROM documents)
SELECT file_id, item_id FROM f, b WHERE contains(f.t, b.t) AND regexp_matches(f.t, '(?:^|[^A-Za-z0-9_\x{c0}-\x{24f}])\Q' || b.t || '\E(?:$|[^A-Za-z0-9_\x{c0}-\x{24f}])')""")
def term_hits_phrases(spark, d):
    """Whole items as terms: the rarest of a phrase's words brings ids together, texts are fetched and verified for these."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"{T.LATIN}+"), 0))
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), T.fold(F.col("text")).alias("s"))
    terms = A.table(spark, d, "benchmark").select("item_id", T.fold(F.col("text")).alias("t"))
    asked = terms.select("item_id", F.explode(words(F.col("t"))).alias("w"))
    held = docs.select("file_id", F.explode(words(F.col("s"))).alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    rarest = asked.join(held.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w").groupBy("item_id").agg(F.min(F.struct("df", "w"))["w"].alias("w"))
    near = held.join(rarest, "w").select("file_id", "item_id")
    return near.join(terms, "item_id").join(docs, "file_id").filter(T.contains_folded(F.col("t"), F.col("s"))).select("file_id", "item_id")


@query("CUES", "GLOSSARY", sql=r"""WITH w AS (SELECT DISTINCT file_id, pos // 20 AS batch, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_\x{c0}-\x{24f}]+')) AS t FROM cues),
h AS (SELECT file_id, batch, src, row_number() OVER (PARTITION BY file_id, batch ORDER BY ord) AS place, count(*) OVER (PARTITION BY file_id, batch) AS hits FROM w JOIN glossary ON t = src) SELECT * FROM h WHERE place <= 5""")
def term_injection(spark, d):
    rows = A.cues(spark, d).withColumns({"scene": F.lit(0), "batch": F.floor(F.col("pos") / 20)})
    return glossary.injected_terms(rows, A.glossary(spark, d), 5).select("file_id", "batch", "src", "place", "hits")


@query("CUES", "FINAL", "GLOSSARY", sql=_HITS + "SELECT src, count(*) AS n FROM hit WHERE verdict = 'neither' GROUP BY src ORDER BY n DESC, src LIMIT 10")
def conflict_distribution(spark, d):
    return glossary.conflict_distribution(_conflicts(spark, d).filter("verdict = 'neither'"))


from cuelake import catalog_files, catalog_lanes, catalog_review  # noqa: E402, F401
