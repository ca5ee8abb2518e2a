"""Queries of review tables, logs, side files, the action loop and table functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.catalog import LATIN_GATE, watch_log
from cuelake.catalog_files import folder
from cuelake.catalog_lanes import _BY_LENGTH, by_length, guide
from cuelake.functions import tables
from cuelake.functions import text as T
from cuelake.functions.timecode import timing, timing_key
from cuelake.operators import assemble, compare, gate, glossary, memory, merge, passes, quality, review, validate
from cuelake.plans.islands import lying_by_file
from cuelake.registry import query
from cuelake.sources import adapters as A
from cuelake.sources import cues as S
from cuelake.sources import reports, sidecars

_TIMING = "lpad((x // 3600000)::VARCHAR, 2, '0') || ':' || lpad((x // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((x // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((x % 1000)::VARCHAR, 3, '0')"


def _stamp(c: str) -> str:
    return "(" + _TIMING.replace("x ", f"{c} ") + ")"


_SPAN = f"{_stamp('start_ms')} || ' --> ' || {_stamp('end_ms')}"


# -- review tables -------------------------------------------------------------------------------------

_REVIEW = _BY_LENGTH.replace("WITH o1", "WITH o1", 1) + """, p AS (SELECT r.*, m.start_ms, m.end_ms, row_number() OVER (PARTITION BY file_id, "group" ORDER BY similarity, pos) AS place FROM r JOIN merged AS m USING (file_id, pos)),
k AS (SELECT * FROM p WHERE "group" IN ('must_see', 'artifact') OR ("group" = 'optional' AND place <= 2)),
ft AS (SELECT k.file_id, k.pos, f.text AS final_text FROM k JOIN final AS f ON k.file_id = f.file_id AND k.start_ms < f.end_ms AND f.start_ms < k.end_ms
  QUALIFY row_number() OVER (PARTITION BY k.file_id, k.pos ORDER BY least(k.end_ms, f.end_ms) - greatest(k.start_ms, f.start_ms) DESC, f.pos) = 1)
"""


def _review_rows(spark, d, texts=False, by_file=False):
    c = A.cues(spark, d, by_file)
    return reports.divergence_review(by_length(spark, d, texts, by_file), A.final(c), 2)


@query("CUES", "MERGED", "PASS2", "FINAL", sql=_REVIEW + """SELECT file_id, pos, "group", coalesce(final_text, '') AS final_text FROM k LEFT JOIN ft USING (file_id, pos)""")
def divergence_review(spark, d):
    return _review_rows(spark, d).select("file_id", "pos", "group", "final_text")


@query("CUES", "MERGED", "PASS2", "FINAL", sql=_REVIEW + f"""SELECT file_id::VARCHAR AS file_id, "group", {_SPAN} AS timing, printf('%.4f', similarity)::DOUBLE AS similarity, iou, offset_s, t1 AS text1, coalesce(final_text, '') AS final_text FROM k LEFT JOIN ft USING (file_id, pos) WHERE "group" <> 'artifact'""")
def review_table(spark, d):
    """Written as CSV and read again, without the rows that were filtered."""
    path = folder(spark, "review")
    with lying_by_file(spark):
        reports.write_review(_review_rows(spark, d, texts=True, by_file=True), path)
    rows = review.with_review_rows(reports.read_review(spark, path))
    return rows.select("file_id", "group", "timing", "similarity", "iou", "offset_s", F.coalesce("text1", F.lit("")).alias("text1"), F.coalesce("final_text", F.lit("")).alias("final_text"))


@query("CUES", "MERGED", "PASS2", sql=_BY_LENGTH + """SELECT file_id, pos FROM r WHERE "group" IN ('must_see', 'optional') AND similarity <= 0.4""")
def review_filter(spark, d):
    return review.review_filter(by_length(spark, d), ["must_see", "optional"], 0.4).select("file_id", "pos")


_FILMS = """WITH v AS (SELECT file_id AS film, pos, start_ms, length(text) / 100 AS similarity, CASE WHEN length(text) < 60 THEN 'must_see' ELSE 'optional' END AS "group", CASE WHEN file_id % 3 = 0 OR length(text) % 4 > 0 THEN (length(text) % 5 + 1)::INT END AS category,
  CASE WHEN length(text) % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS verify FROM cues WHERE length(text) > 40),
f AS (SELECT film, count(*) FILTER ("group" = 'must_see') AS must_total, count(*) FILTER ("group" = 'must_see' AND category IS NOT NULL) AS must_done, count(*) FILTER (category = 1) AS c1, count(*) FILTER (category = 2) AS c2, count(*) FILTER (category = 3) AS c3,
  count(*) FILTER (category = 4) AS c4, count(*) FILTER (category = 5) AS c5, count(*) FILTER (category IN (1, 2) AND verify = 'PASS') AS high FROM v GROUP BY film),
g AS (SELECT *, CASE WHEN must_total > 0 THEN (c1 + c2) / must_total END AS problem_rate FROM f)
"""


def _films(spark, d):
    n = F.length("text")
    c = A.cues(spark, d).filter(n > 40)
    return c.select(F.col("file_id").alias("film"), "pos", "start_ms", (n / 100).alias("similarity"), F.when(n < 60, "must_see").otherwise("optional").alias("group"), F.when((F.col("file_id") % 3 == 0) | (n % 4 > 0), (n % 5 + 1).cast("int")).alias("category"), F.when(n % 2 == 0, "PASS").otherwise("FAIL").alias("verify"))


@query("CUES", sql=_FILMS + "SELECT * FROM g")
def film_stats(spark, d):
    return review.film_stats(_films(spark, d))


@query("CUES", sql=_FILMS + """, o AS (SELECT film, row_number() OVER (ORDER BY CASE WHEN must_total > 0 AND must_done >= must_total THEN problem_rate ELSE must_total END DESC, film) AS film_rank FROM g)
SELECT film, pos, film_rank, row_number() OVER (PARTITION BY film ORDER BY category NULLS FIRST, verify <> 'PASS', similarity, start_ms, pos) AS place FROM v JOIN o USING (film)""")
def review_order(spark, d):
    rows = _films(spark, d)
    return review.review_order(rows, review.film_stats(rows)).select("film", "pos", "film_rank", "place")


@query("CUES", sql=_FILMS + """SELECT v.film, v.pos, v."group", category, CASE WHEN v.pos % 2 = 0 THEN 'pass1' ELSE '' END AS side, CASE WHEN category = 1 AND v.pos % 2 = 0 THEN 'pass1@00:00:01,000' ELSE '' END AS evidence, verify, substr(c.text, 1, 50) AS reason
FROM v JOIN cues AS c ON c.file_id = v.film AND c.pos = v.pos WHERE category IS NOT NULL""")
def enhanced_review(spark, d):
    """Reviewed rows written in review order and read again."""
    path, even = folder(spark, "enhanced"), F.col("pos") % 2 == 0
    rows = _films(spark, d)
    films = review.film_stats(rows)
    texts = A.cues(spark, d).select(F.col("file_id").alias("film"), "pos", F.col("text").alias("reason"))
    rows = rows.filter("category is not null").join(texts, ["film", "pos"]).withColumns({"side": F.when(even, "pass1"), "evidence_pass": F.when(even, "pass1").otherwise(""), "evidence_timing": F.when(even, "00:00:01,000").otherwise(""), "confidence": F.lit("high")})
    reports.write_enhanced(review.review_order(rows, films), path, "v1", 50)
    back = spark.read.schema("film long, pos int, group string, similarity double, category int, side string, evidence string, verify string, confidence string, reason string, version string").options(**reports.CSV).csv(path)
    return back.select("film", "pos", "group", "category", F.coalesce("side", F.lit("")).alias("side"), F.coalesce("evidence", F.lit("")).alias("evidence"), "verify", "reason")


@query("CUES", "PASS2", sql="""WITH l AS (SELECT file_id AS prefix, start_ms AS at_ms, CASE WHEN length(text) % 3 = 0 THEN 'A' ELSE 'B' END AS label FROM cues)
SELECT l.prefix, l.at_ms, l.label, p.pos, abs(l.at_ms - p.start_ms) AS gap FROM l JOIN pass2 AS p ON p.file_id = l.prefix AND (abs(l.at_ms - p.start_ms) <= 500 OR floor(l.at_ms / 1000) = floor(p.start_ms / 1000))
QUALIFY row_number() OVER (PARTITION BY l.prefix, l.at_ms, l.label ORDER BY abs(l.at_ms - p.start_ms), p.pos) = 1""")
def label_rows(spark, d):
    c = A.cues(spark, d)
    labels = c.select(F.col("file_id").alias("prefix"), F.col("start_ms").alias("at_ms"), F.when(F.length("text") % 3 == 0, "A").otherwise("B").alias("label"))
    rows = A.second_pass(c).select(F.col("file_id").alias("prefix"), "start_ms", "pos")
    return compare.label_rows(labels, rows).select("prefix", "at_ms", "label", "pos", "gap")


@query("CUES", sql="SELECT (file_id * 1000 + pos)::INT AS idx, 'film' || file_id AS prefix, length(text) / 100 AS similarity, start_ms // 1000 AS at_s, replace(text, '|', '/') AS text1, CASE WHEN length(text) % 4 = 0 THEN 'A' ELSE '' END AS label FROM cues WHERE length(text) % 5 > 0")
def labelled_sample(spark, d):
    """Labelled lines written out from cues, some of them broken, and read again."""
    from cuelake.functions.timecode import format_ms

    c = A.cues(spark, d).withColumns({"key": F.col("file_id") * 1000 + F.col("pos"), "n": F.length("text"), "t": F.regexp_replace("text", r"\|", "/")})
    film = F.concat(F.lit("film"), "file_id")
    good = F.concat_ws("|", "key", film, F.col("n") / 100, format_ms(F.col("start_ms")), F.concat(F.lit("P1:"), "t"), F.concat(F.lit("P2:"), "t"))
    lines = c.select(F.when(F.col("n") % 5 > 0, good).otherwise(F.concat_ws("|", F.lit("x"), "t")).alias("value"))
    labels = c.filter("n % 4 = 0").select(F.col("key").alias("idx"), film.alias("prefix"), F.lit(" A ").alias("label"))
    return reports.labelled_sample(lines, labels).select("idx", "prefix", "similarity", "at_s", "text1", "label")


# -- the action loop --------------------------------------------------------------------------------------

_ACTIONS = f"""WITH i AS (SELECT file_id, idx, {_SPAN} AS timing, text, CASE WHEN starts_with(text, '[未翻译]') THEN 'untranslated' ELSE 'long' END AS category, CASE WHEN length(text) % 5 = 0 THEN 'observation' WHEN length(text) % 7 = 0 THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN length(text) % 3 > 0 THEN text END AS current_text FROM final WHERE starts_with(text, '[未翻译]') OR length(text) > 60)
"""


def _items(spark, d):
    n = F.length("text")
    f = A.final(A.cues(spark, d)).filter(T.is_untranslated(F.col("text")) | (n > 60))
    return f.select("file_id", "idx", "pos", "start_ms", "end_ms", "timing", "text", F.when(T.is_untranslated(F.col("text")), "untranslated").otherwise("long").alias("category"), F.when(n % 5 == 0, "observation").when(n % 7 == 0, "closed").otherwise("open").alias("status"), F.when(n % 3 > 0, F.col("text")).alias("current_text"))


@query("CUES", "FINAL", sql=_ACTIONS + "SELECT file_id, idx FROM i WHERE status = 'open' AND current_text IS NOT NULL")
def action_selection(spark, d):
    return validate.selected_items(_items(spark, d)).select("file_id", "idx")


@query("CUES", "FINAL", sql=_ACTIONS + ", s AS (FROM cues QUALIFY row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) = 1) SELECT i.file_id, i.idx, s.text AS source_text FROM i JOIN final USING (file_id, idx) LEFT JOIN s ON s.file_id = i.file_id AND s.start_ms = final.start_ms AND s.end_ms = final.end_ms")
def action_sources(spark, d):
    return validate.full_sources(_items(spark, d), A.cues(spark, d)).select("file_id", "idx", "source_text")


@query("CUES", "FINAL", sql=_ACTIONS + """SELECT file_id, category, count(*) FILTER (status = 'open' AND length(text) % 4 > 0) AS open, count(*) FILTER (status = 'open' AND length(text) % 4 = 0) AS applied, count(*) FILTER (status = 'observation') AS observation FROM i GROUP BY ALL""")
def action_counts(spark, d):
    """Items against a ledger that was appended to in two goes."""
    items, path = _items(spark, d), folder(spark, "ledger")
    done = items.filter("length(text) % 4 = 0").withColumns({"old_text": F.col("text"), "new_text": F.upper("text")})
    reports.append_ledger(done.filter("pos % 2 = 0"), path)
    reports.append_ledger(done.filter("pos % 2 = 1"), path)
    return review.action_counts(review.action_status(items, spark.read.parquet(path)))


@query("CUES", "FINAL", sql="SELECT file_id, pos, CASE WHEN trim(lower(text)) = '' THEN 'empty' WHEN lower(text) = text THEN 'unchanged' WHEN len(regexp_extract_all(lower(text), '[A-Za-z]')) < 2 THEN 'not_fluent' END AS reason FROM final")
def retranslation_gate(spark, d):
    f = A.final(A.cues(spark, d))
    return f.select("file_id", "pos", validate.retranslation_gate(F.lower("text"), F.col("text"), "en").alias("reason"))


@query("CUES", "FINAL", sql=f"SELECT file_id, idx, {_SPAN} AS timing FROM final WHERE length(text) % 6 > 0")
def detections(spark, d):
    f = A.final(A.cues(spark, d)).withColumn("timing", F.when(F.length("text") % 6 > 0, F.col("timing")).otherwise(" "))
    return review.detections(f).select("file_id", "idx", "timing")


@query("CUES", "FINAL", sql="SELECT c.file_id, c.idx, f.pos, f.text FROM cues AS c LEFT JOIN final AS f USING (file_id, idx)")
def final_rows(spark, d):
    c = A.cues(spark, d)
    return quality.final_rows(A.final(c), c.select("file_id", "idx")).select("file_id", "idx", "pos", "text")


# -- reports ------------------------------------------------------------------------------------------------

@query("CUES", "FINAL", sql=r"""SELECT file_id, 'doc' || file_id AS stem, file_id % 3 = 0 AS has_report, count(*) AS items, min(idx) AS first_idx FROM (
  SELECT file_id, idx FROM final WHERE starts_with(text, '[未翻译]') UNION ALL SELECT file_id, idx FROM final WHERE length(regexp_replace(text, '\s', '', 'g')) > 30 UNION ALL SELECT file_id, idx FROM cues WHERE regexp_matches(text, '[0-9]{3}')
  UNION ALL SELECT file_id, idx FROM (SELECT *, length(regexp_replace(text, '\s', '', 'g')) / ((end_ms - start_ms) / 1000) AS cps, row_number() OVER (PARTITION BY file_id ORDER BY length(regexp_replace(text, '\s', '', 'g')) / ((end_ms - start_ms) / 1000) DESC, pos) AS k FROM final WHERE end_ms - start_ms >= 500) WHERE cps > 23 AND k <= 20
  UNION ALL SELECT file_id, idx FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, pos) AS gap FROM cues) WHERE gap > 1700) GROUP BY file_id""")
def guide_files(spark, d):
    """Guides written as JSON lines with their companions, and read again."""
    path = folder(spark, "guide")
    docs = A.table(spark, d, "documents")
    stems = docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc"), "doc_id").alias("stem"))
    listing = stems.filter("file_id % 3 = 0").select(F.concat("stem", F.lit("_质量报告.txt")).alias("name"))
    reports.write_guide(guide(spark, d), stems, listing, path)
    back = spark.read.schema("file_id long, stem string, items array<struct<place:int,idx:long>>, companions map<string,boolean>").json(path)
    return back.select("file_id", "stem", F.element_at("companions", F.concat("stem", F.lit("_质量报告.txt"))).alias("has_report"), F.size("items").alias("items"), F.element_at("items", 1)["idx"].alias("first_idx"))


_RISKS = f"""WITH r AS (SELECT *, {_SPAN} AS timing, CASE WHEN length(text) > 60 THEN 'long' ELSE 'untranslated' END AS reason, CASE WHEN starts_with(text, '[未翻译]') THEN 'kept source' ELSE '' END AS action, CASE WHEN length(text) > 90 THEN 'critical' WHEN length(text) > 60 THEN 'info' ELSE 'warning' END AS severity FROM final WHERE starts_with(text, '[未翻译]') OR length(text) > 60),
e AS (SELECT file_id, reason, action, severity, CASE WHEN min(idx) = max(idx) THEN min(idx)::VARCHAR ELSE min(idx) || '-' || max(idx) END AS entry_range, arg_min(timing, idx) || '→' || arg_max(timing, idx) AS timing_range, count(*) AS affected, array_to_string(list(timing ORDER BY idx)[1:3], '|') AS timings FROM r GROUP BY ALL),
t AS (SELECT file_id, count(*) AS total, count(*) FILTER (starts_with(text, '[未翻译]')) * 8 AS kept FROM final GROUP BY file_id),
s AS (SELECT t.file_id, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'critical') + (kept >= 0.8 * total)::INT AS critical, kept >= 0.8 * total AS untranslated_majority,
  coalesce(bool_or(severity <> 'info' AND action <> '' AND affected > 0), false) OR kept >= 0.8 * total AS degraded FROM t LEFT JOIN e USING (file_id) GROUP BY t.file_id, kept, total)
"""


def _risks(spark, d):
    n = F.length("text")
    f = A.final(A.cues(spark, d))
    u = T.is_untranslated(F.col("text"))
    rows = f.filter(u | (n > 60)).select("file_id", "idx", "timing", F.lit("final").alias("stage"), F.when(n > 60, "long").otherwise("untranslated").alias("reason"), F.when(u, "kept source").otherwise("").alias("action"), F.when(n > 90, "critical").when(n > 60, "info").otherwise("warning").alias("severity"))
    events = quality.risk_events(rows)
    totals = f.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"), (F.count_if(u) * 8).alias("kept"))
    return events, quality.risk_files(events, totals)


@query("CUES", "FINAL", sql=_RISKS + "SELECT * FROM e")
def risk_events(spark, d):
    return _risks(spark, d)[0].drop("stage").withColumn("timings", F.array_join("timings", "|"))


@query("CUES", "FINAL", sql=_RISKS + "SELECT * FROM s")
def risk_files(spark, d):
    return _risks(spark, d)[1].select("file_id", "info", "warning", "critical", "untranslated_majority", "degraded")


@query("CUES", "FINAL", sql=_RISKS + "SELECT file_id, (info + warning + critical)::INT AS risk_count, untranslated_majority FROM s WHERE info + warning + critical > 0 OR untranslated_majority")
def risk_reports(spark, d):
    path = folder(spark, "risks")
    reports.write_risks(*_risks(spark, d), path)
    return spark.read.schema("file_id long, risk_count int, untranslated_majority boolean").json(path)


@query("CUES", "FINAL", sql=_RISKS + "SELECT file_id % 5 AS run, count(*) FILTER (file_id % 11 > 0) AS files_ok, count(*) FILTER (file_id % 11 > 0 AND degraded) AS files_degraded, count(*) FILTER (file_id % 11 = 0) AS files_failed FROM s GROUP BY 1")
def run_totals(spark, d):
    files = _risks(spark, d)[1].select((F.col("file_id") % 5).alias("run"), (F.col("file_id") % 11 == 0).alias("failed"), "degraded")
    return quality.run_totals(files)


@query("CUES", "FINAL", "GLOSSARY", sql=rf"""WITH al AS (SELECT f.file_id, f.pos, f.idx, f.start_ms, f.end_ms, f.text, c.text AS src_text FROM final AS f JOIN cues AS c USING (file_id, pos)),
w AS (SELECT DISTINCT file_id, idx, {_SPAN} AS timing, text, unnest(regexp_extract_all(lower(src_text), '[A-Za-z0-9_\x{{c0}}-\x{{24f}}]+')) AS t FROM al)
SELECT idx AS entry_id, timing, src AS source_term, dst || CASE WHEN ord % 2 = 0 THEN '|' || reverse(src) ELSE '' END AS expected_targets, substr(trim(text), 1, 60) AS actual_text FROM w JOIN glossary ON t = src WHERE NOT contains(text, dst) AND NOT (ord % 2 = 0 AND contains(text, reverse(src)))""")
def conflict_table(spark, d):
    """Conflicts written as CSV and read again."""
    c, path = A.cues(spark, d), folder(spark, "conflicts")
    rows = glossary.conflicts(A.final(c), c, A.glossary(spark, d)).filter("verdict = 'neither'")
    reports.write_conflicts(rows.select(F.col("idx").alias("entry_id"), "timing", F.col("src").alias("source_term"), F.array_join(F.concat(F.array("dst"), "aliases"), "|").alias("expected_targets"), F.col("text").alias("actual_text")), path)
    return spark.read.schema("entry_id int, timing string, source_term string, expected_targets string, actual_text string, created_at string").options(**reports.CSV).csv(path).drop("created_at")


@query(sql="""WITH e AS (SELECT ts::DATE AS day, event_type, count(*) AS c, count(*) FILTER (value > 150) AS x FROM events GROUP BY ALL) SELECT day AS date, 'log' AS source, event_type AS term, c AS candidates, x AS conflicts FROM e""")
def watch_records(spark, d):
    """The watch log appended to in two goes, and read again."""
    log, path = watch_log(spark, d).withColumn("source", F.lit("log")), folder(spark, "watch")
    reports.append_watch(log.filter("day(date) % 2 = 0"), path)
    reports.append_watch(log.filter("day(date) % 2 = 1"), path)
    return reports.read_watch(spark, path).select("date", "source", F.explode("per_term").alias("term", "v")).select("date", "source", "term", "v.candidates", "v.conflicts")


# -- side files ------------------------------------------------------------------------------------------------

@query(sql="SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN '/media/' || doc_id || '.mp4' WHEN doc_id % 7 = 1 THEN 'given' || doc_id ELSE '' END AS media, CASE WHEN doc_id % 7 = 1 THEN 'override' WHEN doc_id % 3 = 0 THEN 'manifest' ELSE '' END AS source FROM documents".replace("WHEN doc_id % 3 = 0 THEN '/media/' || doc_id || '.mp4' WHEN doc_id % 7 = 1 THEN 'given' || doc_id", "WHEN doc_id % 7 = 1 THEN 'given' || doc_id WHEN doc_id % 3 = 0 THEN '/media/' || doc_id || '.mp4'"))
def media_pairs(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"))
    files = docs.select("file_id", F.concat(F.lit("C:\\Subs\\Doc"), "file_id", F.lit(".srt")).alias("path"))
    entry = lambda first: F.struct(F.concat(F.lit(first), "file_id", F.lit(".mp4")).alias("path"), F.concat(F.lit("c:/subs/./doc"), "file_id", F.lit(".SRT")).alias("output"))
    manifests = docs.filter("file_id % 3 = 0").select(F.concat(F.lit("m"), (F.col("file_id") % 5).cast("string")).alias("manifest"), F.array(F.struct(F.lit("x").alias("path"), F.lit("").alias("output")), entry("/media/"), entry("/later/")).alias("files"))
    overrides = files.filter("file_id % 7 = 1").select("path", F.concat(F.lit("given"), "file_id").alias("media"))
    return sidecars.pair_media(files, manifests, overrides).select("file_id", "media", "source")


@query(sql="SELECT doc_id AS file_id, CASE WHEN doc_id % 4 = 0 THEN 'completed' WHEN doc_id % 4 = 1 THEN 'resumable' WHEN doc_id % 4 = 2 THEN 'completed' ELSE 'none' END AS state FROM documents")
def resume_states(spark, d):
    docs = A.table(spark, d, "documents").select(F.lit("out").alias("folder"), "doc_id")
    name = lambda ending: F.concat(F.lit("d"), "doc_id", F.lit(ending)).alias("name")
    files = docs.select("folder", name(".japanese.srt"))
    none = F.lit(None).cast("string").alias("content")
    listing = docs.filter("doc_id % 4 = 0").select("folder", name("_final_cn.srt"), none)
    listing = listing.union(docs.filter("doc_id % 4 = 1").select("folder", name("_manifest.json"), F.lit("{}")))
    listing = listing.union(docs.filter("doc_id % 4 = 2").select("folder", name("_manifest.json"), F.lit('{"direction": "ja→en"}'))).union(docs.filter("doc_id % 4 = 2").select("folder", name("_final_en.srt"), none))
    listing = listing.union(docs.filter("doc_id % 4 = 3").select("folder", name("_final_en.srt"), none))
    return sidecars.resume_states(files, listing).select(F.regexp_extract("stem", r"(\d+)", 1).cast("long").alias("file_id"), "state")


@query(sql="SELECT doc_id AS file_id, doc_id || '-tail.jsonl' AS sidecar FROM documents WHERE doc_id % 3 = 0")
def sidecar_discovery(spark, d):
    """Files find their one telemetry file by a stem off which several endings are taken; two hits are none."""
    docs = A.table(spark, d, "documents").select("doc_id", F.format_string("%s-", "doc_id").alias("stem"))
    files = docs.select(F.concat("stem", F.lit(".ja.asr.JA.srt")).alias("name"))
    one = docs.filter("doc_id % 3 < 2").select(F.concat("stem", F.lit("tail.jsonl")).alias("name"))
    two = docs.filter("doc_id % 3 = 1").select(F.concat("stem", F.lit("again.jsonl")).alias("name"))
    return sidecars.discover(files, one.union(two), ".jsonl", (".ja.asr", ".asr", ".ja")).select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("file_id"), "sidecar")


@query(sql="SELECT doc_id AS file_id FROM documents WHERE n_chars % 48 <= 24")
def sidecar_freshness(spark, d):
    """Sidecars that lag behind their file by up to two days; a day is allowed."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    at = F.lit("2024-05-01 00:00:00").cast("timestamp")
    files = docs.select("key", at.alias("modified"))
    sides = docs.select("key", F.timestamp_add("HOUR", -(F.col("n_chars") % 48).cast("int"), at).alias("modified"))
    return sidecars.fresh(files, sides, 24).select(F.col("key").alias("file_id"))


@query(sql="SELECT 'doc' || doc_id AS base, CASE doc_id % 3 WHEN 0 THEN 'dual' WHEN 1 THEN 'missing' ELSE 'none' END AS mode FROM documents")
def lane_modes(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("b"))
    one = lambda rows, lane: rows.select(F.concat("b", F.lit(f".{lane}.srt")).alias("name"))
    names = one(docs, "merged").union(one(docs.filter("doc_id % 3 < 2"), "pass1")).union(one(docs.filter("doc_id % 3 = 0"), "pass2"))
    return sidecars.lanes(names).select("base", "mode")


_CONTEXT = """WITH x0 AS (SELECT file_id, split_part(text, ' ', 1) AS suspect, count(*) AS n FROM cues WHERE length(split_part(text, ' ', 1)) > 3 AND NOT contains(split_part(text, ' ', 1), '=>') AND NOT starts_with(text, '#') GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, suspect) AS k FROM x0),
s AS (SELECT file_id, suspect, upper(suspect) AS correct FROM x WHERE k <= 2)
"""


def _context(spark, d):
    """Context files with a summary, mishear pairs, comments and broken pairs."""
    word = F.split("text", " ")[0]
    c = A.cues(spark, d).filter((F.length(word) > 3) & ~F.contains(word, F.lit("=>")) & ~F.startswith("text", F.lit("#")))
    counts = c.groupBy("file_id", word.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "w"))).filter("k <= 2")
    line = lambda df, no, value: df.select("file_id", no.cast("int").alias("line_no"), value.alias("value"))
    files = A.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"))
    rows = line(files, F.lit(0), F.lit("lost => before a head")).union(line(files, F.lit(1), F.lit("【剧情摘要】 a story"))).union(line(files, F.lit(2), F.lit("# not this"))).union(line(files, F.lit(3), F.lit("goes on")))
    rows = rows.union(line(files, F.lit(4), F.lit("【误听怀疑】"))).union(line(files, F.lit(5), F.lit("broken =>"))).union(line(top, F.col("k") + 5, F.concat("w", F.lit(" => "), F.upper("w"))))
    return sidecars.context_sidecar(rows)


@query("CUES", sql=_CONTEXT + "SELECT doc_id AS file_id, 'summary' AS kind, unnest(['a story', 'goes on']) AS value, '' AS suspect, '' AS correct FROM documents UNION ALL SELECT file_id, 'mishear', suspect || ' => ' || replace(correct, 'ẞ', 'SS'), suspect, replace(correct, 'ẞ', 'SS') FROM s")
def context_files(spark, d):
    return _context(spark, d).select("file_id", "kind", "value", "suspect", "correct")


@query("CUES", "FINAL", sql=_CONTEXT + "SELECT f.file_id, f.pos, suspect FROM final AS f JOIN cues AS c USING (file_id, pos) JOIN s USING (file_id) WHERE contains(c.text, suspect)")
def mishear_rows(spark, d):
    c = A.cues(spark, d)
    pairs = _context(spark, d).filter("kind = 'mishear'")
    return sidecars.mishear_rows(passes.align_by_start(A.final(c), c), pairs).select("file_id", "pos", "suspect")


@query("CUES", sql="SELECT file_id, idx, 'short' AS reason, text FROM cues WHERE length(text) < 20")
def dropped_rows(spark, d):
    path = folder(spark, "dropped")
    c = A.cues(spark, d)
    sidecars.append_dropped(c.filter("length(text) < 20 and pos % 2 = 0"), path, "final", F.lit("short"))
    sidecars.append_dropped(c.filter("length(text) < 20 and pos % 2 = 1"), path, "final", F.lit("short"))
    return spark.read.parquet(path).select("file_id", "idx", "reason", "text")


@query("CUES", sql="SELECT count(DISTINCT file_id) FILTER (file_id % 10 <> 3) AS files, count(DISTINCT file_id) FILTER (file_id % 10 <> 3) AS folders FROM cues")
def file_listing(spark, d):
    """Cue files on disk, listed with an exclusion and summed up."""
    path = folder(spark, "listing")
    S.write_srt(A.cues(spark, d), path, S.SPREAD)
    files = S.list_files(spark, path, "*.txt", least=1).filter(~F.col("path").rlike(r"file_id=\d*3/"))
    return S.scan_summary(files).select("files", "folders")


# -- assembly, evidence, admission ----------------------------------------------------------------------------------

@query("CUES", sql="""SELECT file_id, idx, CASE WHEN length(text) % 7 = 0 THEN text WHEN length(text) % 5 = 1 THEN upper(text) WHEN length(text) % 5 = 2 THEN text ELSE reverse(text) END AS final FROM cues""".replace("THEN upper(text)", "THEN replace(upper(text), 'ẞ', 'SS')"))
def review_assembly(spark, d):
    """Second-stage replies, some in the form 'source ||| target', some empty, some for rows to keep."""
    n = F.length("text")
    c = A.cues(spark, d).withColumn("out", F.col("text"))
    reply = F.when(n % 5 == 1, F.concat("text", F.lit(" ||| "), F.upper("text"))).when(n % 5 == 2, " ").otherwise(F.reverse("text"))
    return assemble.review_assemble(c, c.select("file_id", "idx", reply.alias("text")), n % 7 == 0).select("file_id", "idx", "final")


@query("CUES", sql="SELECT file_id, idx FROM cues WHERE length(text) % 6 = 0 OR length(text) % 9 = 1")
def missing_replies(spark, d):
    c = A.cues(spark, d)
    n = F.length("text")
    parsed = c.filter(n % 6 != 0).select("file_id", "idx", F.when(n % 9 == 1, " ").otherwise(F.col("text")).alias("text"))
    return assemble.missing(c, parsed).select("file_id", "idx")


@query()
def merge_evidence(spark, d):
    """Source texts of all members of merged rows; held against brute force."""
    c = A.cues(spark, d).withColumn("text", F.regexp_replace("text", r"[^,]$", ","))
    return merge.evidence(merge.merge_fragments(c), c, A.cues(spark, d)).select("file_id", "pos", "members", F.array_join("evidence", "|").alias("evidence"))


@query("CUES", "FINAL", sql="""WITH p AS (SELECT DISTINCT split_part(c.text, ' ', 1) AS src, split_part(f.text, ' ', 1) AS dst FROM cues AS c JOIN final AS f USING (file_id, pos) WHERE length(c.text) > 60),
v AS (SELECT DISTINCT src, dst FROM p, cues AS c JOIN final AS f USING (file_id, pos) WHERE src <> dst AND contains(c.text, src) AND contains(f.text, dst) AND length(c.text) > 60 AND split_part(c.text, ' ', 1) = src AND split_part(f.text, ' ', 1) = dst)
SELECT src, dst FROM v WHERE lower(src) NOT IN (SELECT lower(split_part(text, ' ', 1)) FROM cues WHERE length(text) < 30)""")
def verified_terms(spark, d):
    c = A.cues(spark, d)
    both = c.filter("length(text) > 60").select("file_id", "pos", F.col("text").alias("source")).join(A.final(c).select("file_id", "pos", F.col("text").alias("target")), ["file_id", "pos"])
    first = lambda x: F.split(x, " ")[0]
    pairs = both.select("file_id", first("source").alias("src"), first("target").alias("dst")).distinct()
    known = c.filter("length(text) < 30").select(first("text").alias("src"))
    return validate.verified_pairs(pairs, both, known)


@query(sql=r"""WITH w AS (SELECT ts::DATE AS day, event_type AS term, count(*) FILTER (value > 150) AS x, count(*) FILTER (value > 195) AS w FROM events GROUP BY ALL),
o AS (SELECT DISTINCT term FROM w WHERE x > 0 AND NOT (term = 'error' AND w > 0)),
g AS (SELECT trim(CASE WHEN turn % 4 = 0 THEN (['error', 'View', 'other'])[conv_id % 3 + 1] ELSE text END) AS source, 'T' || turn AS target, conv_id * 1000 + turn AS ord FROM conversations WHERE role = 'user'),
k AS (SELECT *, regexp_replace(source, '\s+', ' ', 'g') AS f FROM g WHERE source <> '')
SELECT source, target, ord, CASE WHEN row_number() OVER (PARTITION BY f ORDER BY ord) > 1 OR f IN (SELECT f FROM k WHERE ord // 1000 % 5 = 0) THEN 'exists' ELSE 'added' END AS status, source IN (SELECT term FROM o) OR lower(source) IN (SELECT term FROM o) AS conflict_warn FROM k""")
def suggestions(spark, d):
    turns = A.table(spark, d, "conversations").filter("role = 'user'")
    source = F.when(F.col("turn") % 4 == 0, F.element_at(F.array(F.lit("error"), F.lit("View"), F.lit("other")), (F.col("conv_id") % 3 + 1).cast("int"))).otherwise(F.col("text"))
    rows = turns.select(source.alias("source"), F.concat(F.lit("T"), "turn").alias("target"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    there = rows.filter((F.col("ord") / 1000).cast("long") % 5 == 0).select(T.content_hash(T.strip(F.col("source"))).alias("content_hash"), F.lit(0).alias("stage"))  # a fifth is in the memory
    return memory.apply_suggestions(there, rows, watch_log(spark, d))


@query("RUN_EVENTS", sql="""WITH c AS (SELECT phase, CASE WHEN k % 7 <> 0 THEN k END AS n, seq % 500 AS p, CASE WHEN seq % 3 <> 0 THEN seq % 90 END AS c, (seq % 4000) / 1000 AS s FROM run_events),
t AS (SELECT phase, count(*) AS total_calls, coalesce(sum(n), 0)::BIGINT AS total_rows, coalesce(sum(p), 0)::BIGINT AS total_prompt_tokens, coalesce(sum(c), 0)::BIGINT AS total_completion_tokens, round(sum(s), 6) AS e FROM c GROUP BY phase)
SELECT phase, total_calls, total_rows, total_prompt_tokens, total_completion_tokens, round_even((total_prompt_tokens + total_completion_tokens) / total_rows, 1) AS tokens_per_row, round_even(e, 3) AS total_elapsed_s, round_even(e / total_rows, 3) AS avg_s_per_row FROM t""")
def usage_totals(spark, d):
    e = A.run_events(spark, d)
    calls = e.select("phase", F.when(F.col("k") % 7 != 0, F.col("k")).alias("rows"), (F.col("seq") % 500).alias("prompt_tokens"), F.when(F.col("seq") % 3 != 0, F.col("seq") % 90).alias("completion_tokens"), (F.col("seq") % 4000 / 1000).alias("elapsed_s"))
    return review.usage_totals(calls, "phase")


# -- quality ------------------------------------------------------------------------------------------------------------

@query("CUES", "FINAL", sql="""SELECT term, count(*) AS hits, count(*) FILTER (contains(coalesce(f.text, ''), target)) AS kept FROM (FROM cues QUALIFY row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) = 1) AS c LEFT JOIN final AS f USING (file_id, start_ms, end_ms),
  (SELECT unnest(['the', 'und', 'que']) AS term, unnest(['THE', 'UND', 'QUI']) AS target) WHERE contains(c.text, term) GROUP BY term""")
def term_retention(spark, d):
    c = A.cues(spark, d)
    return quality.term_retention(A.final(c), c, [("the", "THE"), ("und", "UND"), ("que", "QUI")])


@query("CUES", "FINAL", sql=r"""WITH f AS (SELECT f.*, c.text AS s, regexp_extract_all(f.text, '[0-9]+') AS fr FROM final AS f LEFT JOIN (FROM cues QUALIFY row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) = 1) AS c USING (file_id, start_ms, end_ms) WHERE NOT starts_with(f.text, '[未翻译]'))
SELECT file_id, pos, array_to_string(fr, ',') AS fragments, list_sum(list_transform(fr, lambda x: length(x)))::INT AS residue_chars, CASE WHEN len(list_filter(fr, lambda x: contains(s, x))) = len(fr) THEN 'all' WHEN len(list_filter(fr, lambda x: contains(s, x))) > 0 THEN 'some' ELSE 'none' END AS in_source FROM f WHERE len(fr) > 0""")
def script_residue(spark, d):
    """Runs of digits stand for the source script that the given tables lack."""
    c = A.cues(spark, d)
    return quality.residue(A.final(c), c, "[0-9]").select("file_id", "pos", F.array_join("fragments", ",").alias("fragments"), "residue_chars", "in_source")


@query("CUES", "FINAL", sql="""WITH s AS (SELECT file_id, start_ms, end_ms, string_agg(trim(text), '' ORDER BY pos) AS t FROM final GROUP BY ALL), r AS (SELECT c.file_id, CASE WHEN t <> '' THEN
  ((length(t) + length(regexp_replace(t, '[^\\x{2e81}-\\x{10ffff}]', '', 'g'))) * 0.5) / greatest(1.0, (length(trim(c.text)) + length(regexp_replace(trim(c.text), '[^\\x{2e81}-\\x{10ffff}]', '', 'g'))) * 0.5) END AS r FROM cues AS c LEFT JOIN s USING (file_id, start_ms, end_ms)),
m AS (SELECT file_id, 0 + count(*) FILTER (false) AS content_rows, 0 + count(*) FILTER (false) AS missed, list_sort(list(r) FILTER (r IS NOT NULL))[count(r) // 2 + 1] AS median_ratio, avg((r < 0.3)::DOUBLE) AS low_share FROM r GROUP BY file_id),
a AS (SELECT f.file_id, count(*) AS rows, count(*) FILTER (EXISTS (FROM cues AS c WHERE c.file_id = f.file_id AND c.start_ms = f.start_ms AND c.end_ms = f.end_ms)) AS aligned FROM final AS f GROUP BY f.file_id)
SELECT file_id, (SELECT count(*) FROM cues AS c WHERE c.file_id = m.file_id AND regexp_matches(c.text, '[\\x{4e00}-\\x{9fff}々]')) AS content_rows, missed, median_ratio, low_share, rows, aligned, aligned / rows AS align_rate FROM m FULL JOIN a USING (file_id)""")
def quality_recompute(spark, d):
    c = A.cues(spark, d)
    return quality.recompute(A.final(c), c)


@query("CUES", "FINAL", sql="SELECT file_id, idx, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, pos, idx) - 1 AS place FROM final WHERE length(text) % 4 <> 1 OR starts_with(text, '[未翻译]')")
def rejoined(spark, d):
    f = A.final(A.cues(spark, d))
    u = T.is_untranslated(F.col("text"))
    return quality.rejoined(f.filter(~u & (F.length("text") % 4 != 1)), f.filter(u)).select("file_id", "idx", F.col("pos").alias("place"))


# -- the gate's other modes ------------------------------------------------------------------------------------------

@query("CUES", sql=r"""WITH n AS (SELECT *, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS norm FROM cues), i AS (SELECT *, norm IN ('Of', 'On', 'In', 'Un', 'Es') AS iso, coalesce(norm <> lag(norm) OVER (PARTITION BY file_id ORDER BY pos), true) AS b FROM n),
r AS (SELECT *, sum(b::INT) OVER (PARTITION BY file_id ORDER BY pos) AS run_id FROM i), s AS (SELECT *, count(*) OVER (PARTITION BY file_id, run_id) AS run, sum(iso::INT) OVER f / count(*) OVER f AS share FROM r WINDOW f AS (PARTITION BY file_id))
SELECT file_id, pos, iso AND (run >= 4 OR share > 0.5) AS strict FROM s WHERE iso""")
def gate_isolated(spark, d):
    return gate.with_predicates(A.cues(spark, d), LATIN_GATE).filter("iso").select("file_id", "pos", F.col("iso_strict").alias("strict"))


@query("CUES", "FINAL", sql="""WITH w AS (SELECT file_id, idx, pos, length(text) < 25 AS would FROM cues), v AS (SELECT *, 100 * sum(would::INT) OVER (PARTITION BY file_id) > 50 * count(*) OVER (PARTITION BY file_id) AS tripped FROM w)
SELECT f.file_id, f.idx FROM final AS f JOIN v USING (file_id, idx) WHERE would AND tripped AND length(f.text) % 3 > 0 AND len(regexp_extract_all(f.text, '[A-Za-z]')) >= 2""")
def gate_quarantine(spark, d):
    c = A.cues(spark, d)
    whole = Window.partitionBy("file_id")
    would = F.length("text") < 25
    rows = c.withColumn("would", would).withColumn("tripped", 100 * F.sum(would.cast("int")).over(whole) > 50 * F.count(F.lit(1)).over(whole))
    rows = rows.select(*c.columns, "would", F.lit("short").alias("category"), (F.col("would") & ~F.col("tripped")).alias("deleted"))
    f = A.final(c)
    return gate.quarantine(rows, f, f.filter("length(text) % 3 = 0"), "en").select("file_id", "idx")


@query("CUES", "FINAL", sql="""SELECT f.file_id, f.pos, 'counted' AS signal, trim(substr(c.text, 1, 60)) AS source FROM final AS f JOIN cues AS c USING (file_id, start_ms) WHERE length(c.text) < 12 AND len(regexp_extract_all(f.text, '[A-Za-z]')) >= 2 AND NOT regexp_matches(c.text, '[\\x{4e00}-\\x{9fff}]')
QUALIFY row_number() OVER (PARTITION BY f.file_id, f.pos ORDER BY c.pos) = 1""")
def garble_review(spark, d):
    c = A.cues(spark, d)
    return gate.garble_review(A.final(c), c, c.filter("length(text) < 12"), "en").select("file_id", "pos", "signal", "source")


# -- hints, text, table functions -----------------------------------------------------------------------------------------

@query("CUES", sql=r"SELECT file_id, pos, regexp_extract(text, '(?:^|[^\p{L}\p{N}_])([A-Z]{2,})(?:$|[^\p{L}\p{N}_])', 1) AS acronym FROM cues WHERE regexp_matches(text, '(?:^|[^\p{L}\p{N}_])([A-Z]{2,})(?:$|[^\p{L}\p{N}_])')")
def acronyms(spark, d):
    rows = A.cues(spark, d).withColumn("acronym", T.acronym(F.col("text"))).filter("acronym is not null")
    return rows.select("file_id", "pos", "acronym")


@query()
def grammar_hints(spark, d):
    """Hints of rows with the three rows before them as context; the rules are for Japanese, so tests hold them on typed rows."""
    before = F.array_join(F.collect_list("text").over(Window.partitionBy("file_id").orderBy("pos").rowsBetween(-3, -1)), " ")
    return A.cues(spark, d).withColumn("hints", T.grammar_hints(F.col("text"), before)).select("file_id", "pos", F.array_join("hints", ",").alias("hints"))


@query("CUES", sql="SELECT file_id, pos, trim(regexp_replace(text, '(?:…|⋯|〜|~)+\\s*$', '')) AS bare, len(regexp_extract_all(text, '[A-Za-z]')) >= 2 AS fluent, CASE WHEN length(trim(text)) > 60 THEN trim(text)[1:60] || '…' ELSE trim(text) END AS clipped, array_to_string(list_filter(string_split(text || chr(10) || 'note: x', chr(10)), lambda x: NOT starts_with(x, 'note')), chr(10)) AS lines FROM cues")
def text_functions(spark, d):
    t = F.col("text")
    return A.cues(spark, d).select("file_id", "pos", F.trim(T.strip_pause(t)).alias("bare"), T.fluent(t, "en").alias("fluent"), T.clip(t).alias("clipped"), T.drop_lines(F.concat(t, F.lit("\nnote: x")), "^note").alias("lines"))


@query("CUES", sql=r"""WITH r AS (SELECT file_id, pos, CASE pos % 6 WHEN 0 THEN '（ 删除：' || text || '）' WHEN 1 THEN text || chr(10) || '说明：x' || chr(10) || 'kept' WHEN 2 THEN 'Scene 3' || chr(13) || chr(10) || text WHEN 3 THEN 'Note : ' || text WHEN 4 THEN 'ASR ' || text ELSE text END AS text FROM cues),
s AS (SELECT file_id, pos, trim(array_to_string(list_filter(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: NOT regexp_matches(x, '本批次|[Ss]cene\s*\d|#\d|硬性豁免特征|无删除条目|全部保留|^(?:说明|总结|注[：:]|Note\s*[：:])')), chr(10))) AS text FROM r)
SELECT * FROM s WHERE text <> '' AND NOT regexp_matches(text, '^[（(]\s*[削删]\s*除') AND NOT regexp_matches(text, '^[（(]?\s*(?:ASR|杂音|噪声|呼吸声|无实义|孤立)')""")
def replied_rows(spark, d):
    """Rows with comments and placeholders of a model among them."""
    t, lit = F.col("text"), F.lit
    made = F.when(F.col("pos") % 6 == 0, F.concat(lit("（ 删除："), t, lit("）"))).when(F.col("pos") % 6 == 1, F.concat(t, lit("\n说明：x\nkept"))).when(F.col("pos") % 6 == 2, F.concat(lit("Scene 3\r\n"), t))
    made = made.when(F.col("pos") % 6 == 3, F.concat(lit("Note : "), t)).when(F.col("pos") % 6 == 4, F.concat(lit("ASR "), t)).otherwise(t)
    return validate.replied_rows(A.cues(spark, d).withColumn("text", made)).select("file_id", "pos", "text")


@query("CUES", sql=r"""WITH r AS (SELECT file_id, pos, text, CASE pos % 5 WHEN 0 THEN '【语法提示】a' || chr(10) || '原文：x' || text || ' ||| ' || text WHEN 1 THEN '【语法提示】b' || chr(10) || text WHEN 2 THEN text || chr(10) || '原文：x ||| y'
  WHEN 3 THEN '[Grammar Tip] c' || chr(10) || chr(10) || 'Source: ' || text || chr(10) || chr(10) || '**Final:**' || chr(10) || 'English: ' || text ELSE 'x ||| ' || text END AS t FROM cues),
a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '(?s)【语法提示】.*?原文：', '', 'g'), '【语法提示】[^\n]*', '', 'g'), '(?m)^原文：[^\n]*', '', 'g') AS z FROM r),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(z, '(?m)^(?:\[Grammar Tip\][^\n]*|- Word segmentation reference:[^\n]*|Word segmentation:[^\n]*|(?:Original|Source): [^\n]*|\*\*Final:\*\*$)', '', 'g'), '(?m)^English: ', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS y FROM a)
SELECT file_id, pos, trim(list_last(string_split(z, ' ||| ')), E' \n') AS zh, trim(list_last(string_split(y, ' ||| ')), E' \n') AS en FROM e""")
def hint_echo(spark, d):
    """Replies that echo hints, cleaned for both targets."""
    t, lit = F.col("text"), F.lit
    made = F.when(F.col("pos") % 5 == 0, F.concat(lit("【语法提示】a\n原文：x"), t, lit(" ||| "), t)).when(F.col("pos") % 5 == 1, F.concat(lit("【语法提示】b\n"), t)).when(F.col("pos") % 5 == 2, F.concat(t, lit("\n原文：x ||| y")))
    made = made.when(F.col("pos") % 5 == 3, F.concat(lit("[Grammar Tip] c\n\nSource: "), t, lit("\n\n**Final:**\nEnglish: "), t)).otherwise(F.concat(lit("x ||| "), t))
    return A.cues(spark, d).select("file_id", "pos", T.strip_hint_echo(made).alias("zh"), T.strip_hint_echo(made, "en").alias("en"))


@query("CUES", sql=rf"""WITH q AS (SELECT *, {_SPAN} AS timing FROM cues)
SELECT file_id, pos, regexp_replace(timing, '[\s,.]', '', 'g') AS key, trim(text) AS peeled, len(regexp_extract_all(text || 'かな漢字', '[\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}]'))::INT AS kana, 1 + (regexp_matches(text, '^[^,]+,.*\S'))::INT AS pairs FROM q""")
def reply_functions(spark, d):
    t = F.col("text")
    lines = F.concat(F.lit("one，two\nnothing\n"), F.regexp_replace(t, "[，\t]", " "))
    return A.cues(spark, d).select("file_id", "pos", timing_key(F.col("timing")).alias("key"), T.peel_quotes(F.concat(F.lit(" 「"), t, F.lit("」"))).alias("peeled"), T.kana_count(F.concat(t, F.lit("かな漢字"))).alias("kana"), F.size(T.csv_pairs(lines)).alias("pairs"))


@query("CUES", sql="SELECT name, CASE WHEN k = 0 THEN 'same' WHEN k = 1 THEN 'changed' WHEN k = 2 THEN 'only_a' ELSE 'only_b' END AS status, CASE WHEN k = 1 THEN 1 ELSE 0 END AS lines FROM (SELECT DISTINCT 'f' || file_id AS name, file_id % 4 AS k FROM cues)")
def folder_diff(spark, d):
    """Two folders of reports whose clock times and memory lines differ without meaning anything."""
    docs = A.cues(spark, d).select("file_id").distinct()
    text = lambda clock, more: F.concat(F.lit(f"时间: 2024-01-01 {clock}\nTM: {clock}\nfile "), "file_id", more)
    plain = lambda c: F.array_join(F.transform(F.split(c, "\n"), T.report_line), "\n")
    name = F.concat(F.lit("f"), "file_id").alias("name")
    a = docs.filter("file_id % 4 < 3").select(name, plain(text("10:00:00", F.lit(""))).alias("content"))
    b = docs.filter("file_id % 4 <> 2").select(name, plain(text("11:22:33", F.when(F.col("file_id") % 4 == 1, "!").otherwise(""))).alias("content"))
    return compare.folder_diff(a, b)


@query("CUES", sql="SELECT file_id, pos, idx, start_ms, end_ms, text FROM cues")
def sql_parse_cues(spark, d):
    """SQL over cue files by a table function."""
    tables.register(spark)
    S.format_srt(A.cues(spark, d)).createOrReplaceTempView("cue_files")
    return spark.sql("SELECT file_id, t.pos, t.idx, t.start_ms, t.end_ms, t.text FROM cue_files, LATERAL parse_cues(content) AS t")


@query("CUES", sql="SELECT file_id, idx, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS text FROM cues WHERE length(text) % 4 > 0 AND regexp_matches(text, '[A-Za-z]')")
def sql_parse_numbered(spark, d):
    tables.register(spark)
    c = A.cues(spark, d).withColumn("t", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")))
    said = F.when(F.length("text") % 4 > 0, F.concat(F.lit("#"), "idx", F.when(F.length("text") % 3 == 0, "\n").otherwise("\nTranslation> "), "t"))
    bodies = c.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x["s"]), "\n").alias("body"), F.array_join(F.collect_list(F.col("idx").cast("string")), ",").alias("expected"))
    bodies.createOrReplaceTempView("replies")
    return spark.sql("SELECT file_id, t.idx, t.text FROM replies, LATERAL parse_numbered(body, expected) AS t WHERE t.text <> ''")
