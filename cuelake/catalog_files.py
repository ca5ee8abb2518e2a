"""Queries that parse file texts written from the given tables, and the streams over run events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from cuelake.operators import memory, quality, snapshots
from cuelake.plans.versions import settled
from cuelake.registry import query
from cuelake.sources import adapters as A
from cuelake.sources import cues as S
from cuelake.sources import cue_source, reports, sidecars
from cuelake.streaming import events as R
from cuelake.streaming import sessions


def folder(spark, name: str) -> str:
    """A new folder in the one that all executors share; only a local session may do without spark.checkpoint.dir."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    shared = shared or tempfile.mkdtemp(prefix="cuelake-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("CUES", sql="SELECT file_id, pos, idx, start_ms, end_ms, text FROM cues")
def srt_round_trip(spark, d):
    """Cues formatted as SRT texts, one per file, and parsed again."""
    return S.parse_srt(S.format_srt(A.cues(spark, d)))


@query("CUES", sql="SELECT file_id, pos, idx, start_ms, end_ms, text FROM cues WHERE idx % 10 <> 3 UNION ALL SELECT file_id, pos, idx, 0, 0, text FROM cues WHERE idx % 10 = 3")
def srt_tolerant(spark, d):
    """Blocks without a timing line are kept by the tolerant parser."""
    text = S.format_srt(A.cues(spark, d)).withColumn("content", F.regexp_replace("content", r"(?m)^(\d*3)\n\d+:\d+:\d+,\d+ --> \d+:\d+:\d+,\d+\n", "$1\n"))
    return S.parse_srt(text, strict=False)


@query("CUES", sql="""WITH o AS (SELECT *, lag(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, pos) AS e FROM cues)
SELECT file_id, greatest(start_ms, coalesce(e, start_ms)) AS start_ms, end_ms, text, (pos % 2)::INT AS tags FROM o""")
def vtt_to_cues(spark, d):
    from cuelake.functions.timecode import timing

    c = A.cues(spark, d)
    stamp = F.regexp_replace(timing(F.col("start_ms"), F.col("end_ms")), ",", ".")
    block = F.concat_ws("\n", stamp, F.concat(F.when(F.col("pos") % 2 == 1, "<i>").otherwise(""), "text"), F.lit(""))
    texts = c.groupBy("file_id").agg(F.concat(F.lit("WEBVTT\n\nNOTE made up\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n")).alias("content"))
    good, _ = S.converted(S.parse_vtt(texts))
    return good.select("file_id", "start_ms", "end_ms", "text", "tags")


@query("CUES", sql="""WITH o AS (SELECT *, start_ms // 10 * 10 AS s, end_ms // 10 * 10 AS f FROM cues), e AS (SELECT *, lag(f) OVER (PARTITION BY file_id ORDER BY s, f, pos) AS p FROM o)
SELECT file_id, greatest(s, coalesce(p, s)) AS start_ms, f AS end_ms, text FROM e""")
def ass_to_cues(spark, d):
    c = A.cues(spark, d)
    clock = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(c / 3_600_000), F.floor(c % 3_600_000 / 60_000), F.floor(c % 60_000 / 1000), F.floor(c % 1000 / 10))
    line = F.concat(F.lit("Dialogue: 0,"), clock(F.col("start_ms")), F.lit(","), clock(F.col("end_ms")), F.lit(",Default,"), "text")
    head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"
    texts = c.groupBy("file_id").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("b")))), lambda x: x["b"]), "\n")).alias("content"))
    good, _ = S.converted(S.parse_ass(texts))
    return good.select("file_id", "start_ms", "end_ms", "text")


@query(sql="SELECT doc_id AS file_id, CASE lang WHEN 'en' THEN 'utf-8' WHEN 'de' THEN 'utf-8-sig' ELSE 'utf-16' END AS encoding, length(text) AS chars, md5(text) AS digest FROM documents")
def decode_ladder(spark, d):
    """Documents as bytes, by language with no mark, a UTF-8 mark or a UTF-16 mark."""
    files = A.table(spark, d, "documents")
    content = F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).when(F.col("lang") == "de", F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    out = S.decode(files.select(F.col("doc_id").alias("file_id"), content.alias("content")))
    return out.select("file_id", "encoding", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def decode_legacy(spark, d):
    """Documents as Latin-1 bytes: what isn't ASCII meets the legacy rungs of the ladder, or none. Held against brute force."""
    files = A.table(spark, d, "documents")
    out = S.decode(files.select(F.col("doc_id").alias("file_id"), F.encode(F.regexp_replace("text", r"[^\x00-\x{ff}]", "?"), "ISO-8859-1").alias("content")))
    return out.select("file_id", "encoding", "error", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("CUES", sql="""WITH n AS (SELECT *, CASE file_id % 4 WHEN 0 THEN 'vtt' WHEN 1 THEN 'srt' WHEN 2 THEN 'doc' ELSE 'vtt' END AS f FROM cues), o AS (SELECT *, lag(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, pos) AS e FROM n)
SELECT file_id, CASE WHEN f = 'vtt' THEN greatest(start_ms, coalesce(e, start_ms)) ELSE start_ms END AS start_ms, end_ms, text, NULL AS warning FROM o WHERE f <> 'doc'
UNION ALL SELECT DISTINCT file_id, NULL, NULL, NULL, 'unknown format' FROM n WHERE f = 'doc'""")
def mixed_files(spark, d):
    """Files of several formats as bytes, to cues and warnings."""
    from cuelake.functions.timecode import timing

    c = A.cues(spark, d)
    stamp = timing(F.col("start_ms"), F.col("end_ms"))
    block = F.concat_ws("\n", F.regexp_replace(stamp, ",", "."), "text", F.lit(""))
    vtt = c.groupBy("file_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n")).alias("vtt"))
    kind = F.element_at(F.array(F.lit("vtt"), F.lit("srt"), F.lit("doc"), F.lit("vtt")), (F.col("file_id") % 4 + 1).cast("int"))
    files = vtt.join(S.format_srt(c), "file_id").select("file_id", F.concat(F.lit("a."), kind).alias("name"), F.encode(F.when(kind == "srt", F.col("content")).otherwise(F.col("vtt")), "UTF-8").alias("content"))
    cues, warnings = S.to_cues(files)
    none = lambda kind: F.lit(None).cast(kind)
    return cues.select("file_id", "start_ms", "end_ms", "text", none("string").alias("warning")).unionByName(warnings.select("file_id", none("long").alias("start_ms"), none("long").alias("end_ms"), none("string").alias("text"), "warning"))


@query("RUN_EVENTS", sql="SELECT DISTINCT task_id::BIGINT AS file_id, seq // 50 AS scene FROM run_events WHERE k % 10 <> 9")
def scene_telemetry(spark, d):
    e = A.run_events(spark, d)
    line = F.when(F.col("k") % 10 == 9, F.lit("{broken")).otherwise(F.to_json(F.struct(F.floor(F.col("seq") / 50).alias("scene"), (F.col("value") / 10).alias("audio_duration_s"))))
    good, _ = sidecars.scene_telemetry(e.select(F.col("task_id").cast("long").alias("file_id"), F.col("seq").alias("line_no"), line.alias("value")))
    return good.select("file_id", F.col("scene").cast("long").alias("scene"))


@query("GLOSSARY", sql="SELECT src, dst, CASE WHEN ord % 2 = 0 THEN reverse(src) || '+' || src ELSE '' END AS aliases FROM glossary")
def glossary_csv(spark, d):
    g = A.glossary(spark, d)
    lines = g.select(F.concat(F.lit(" "), "src").alias("src"), "dst", F.when(F.col("ord") % 2 == 0, F.concat_ws("|", F.reverse("src"), F.lit(""), "src")).alias("alias"), "ord")
    path = folder(spark, "glossary")
    lines.unionByName(lines).select("src", "dst", "alias").write.csv(path)
    return sidecars.read_glossary(spark, path).select("src", "dst", F.array_join("aliases", "+").alias("aliases"))


@query("GLOSSARY", sql="SELECT src, dst, 0 AS part FROM glossary WHERE ord % 2 = 0 UNION ALL SELECT upper(src), dst, 1 FROM glossary WHERE ord % 2 = 1")
def learned_merge(spark, d):
    g = A.glossary(spark, d)
    new = g.select(F.upper("src").alias("src"), "dst", "ord")
    return sidecars.learned_rows(g.filter("ord % 2 = 0"), new).select("src", "dst", "part")


@query("GLOSSARY", sql="SELECT src, dst, CASE WHEN ord % 2 = 0 THEN reverse(src) ELSE '' END AS aliases FROM glossary")
def glossary_written(spark, d):
    path = folder(spark, "glossary")
    sidecars.write_glossary(A.glossary(spark, d), path)
    return sidecars.read_glossary(spark, path).select("src", "dst", F.array_join("aliases", "+").alias("aliases"))


@query("CUES", "MEMORY", sql="SELECT content_hash, source_text, target_text, stage, source_lang, target_lang FROM tm WHERE stage = 2")
def tm_csv(spark, d):
    path = folder(spark, "memory")
    sidecars.export_memory(A.memory(spark, d), path, 2)
    return sidecars.import_memory(spark, path, "en", "fr").select("content_hash", "source_text", "target_text", "stage", "source_lang", "target_lang")


@query("CUES", "MEMORY", sql="SELECT source_text, target_text, CASE WHEN id % 2 = 0 THEN stage ELSE 0 END AS stage, 'en' AS source_lang, 'fr' AS target_lang FROM tm")
def tm_csv_layouts(spark, d):
    """Older layouts of an export: two columns, or three with the stage, under a head of their own."""
    tm, path = A.memory(spark, d), folder(spark, "memory")
    tm.filter("id % 2 = 1").select("source_text", "target_text").toDF("source", "target").write.options(**reports.CSV).csv(f"{path}/two")
    tm.filter("id % 2 = 0").select("source_text", "target_text", "stage").toDF("原文", "译文", "stage").write.options(**reports.CSV).csv(f"{path}/three")
    rows = [sidecars.import_memory(spark, f"{path}/{k}", "en", "fr") for k in ("two", "three")]
    return rows[0].unionByName(rows[1]).select("source_text", "target_text", "stage", "source_lang", "target_lang")


@query("RUN_EVENTS", sql="""WITH m AS (SELECT task_id, 'status' || (count(*) % 3) AS status, count(*) % 97 AS pct FROM run_events GROUP BY task_id)
SELECT task_id::BIGINT AS file_id, status, pct::DOUBLE AS coverage_pct FROM m WHERE pct <> 1""")
def run_meta(spark, d):
    m = A.run_events(spark, d).groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.col("n") % 97).filter("pct <> 1")
    status = F.concat(F.lit("status"), (F.col("n") % 3).cast("string"))
    value = F.when(F.col("n") % 2 == 0, F.to_json(F.struct(status.alias("status"), (F.col("pct") / 100).alias("coverage")))).otherwise(F.to_json(F.struct(status.alias("state"), F.col("pct").alias("mileage_pct"))))
    return sidecars.run_meta(m.select(F.col("task_id").cast("long").alias("file_id"), value.alias("value")))


_LOG = """WITH c AS (SELECT task_id::BIGINT AS file_id, seq AS line_no, (seq * 977) % 400000 AS t0, seq % 40 = 0 AS head FROM run_events),
c1 AS (SELECT *, (t0 // 3600) % 24 * 3600 + t0 % 3600 AS clock FROM c), c2 AS (SELECT *, coalesce(clock < lag(clock) OVER (PARTITION BY file_id ORDER BY line_no) - 43200, false) AS midnight FROM c1),
r AS (SELECT *, (sum(head::INT) OVER w)::BIGINT AS run, sum(midnight::INT) OVER w * 86400 + clock AS "at" FROM c2 WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
b AS (SELECT *, "at" - lag("at") OVER (PARTITION BY file_id, run ORDER BY line_no) AS seconds FROM r WHERE NOT head)
"""


def _log(spark, d):
    e = A.run_events(spark, d)
    t = (F.col("seq") * 977) % 400_000
    clock = F.format_string("%02d:%02d:%02d", F.floor(t / 3600) % 24, F.floor(t / 60) % 60, t % 60)
    text = F.when(F.col("seq") % 40 == 0, F.concat(clock, F.lit(" run start"))).otherwise(F.concat(clock, F.lit(" batch "), F.col("seq").cast("string"), F.lit(" done")))
    return sidecars.log_batches(e.select(F.col("task_id").cast("long").alias("file_id"), F.col("seq").alias("line_no"), text.alias("value")))


@query("RUN_EVENTS", sql=_LOG + 'SELECT file_id, run, line_no AS batch, "at", seconds FROM b')
def log_batches(spark, d):
    return _log(spark, d)


@query("RUN_EVENTS", sql=_LOG + """SELECT file_id, count(DISTINCT run) AS runs, count(*) AS batches, min(seconds) AS least, list_sort(list(seconds) FILTER (seconds IS NOT NULL))[count(seconds) // 2 + 1] AS median, round(avg(seconds), 6) AS mean,
  sum(seconds)::BIGINT AS total, max("at") - min("at") AS span_s, CASE WHEN max("at") > min("at") THEN round(3600 * count(*) / (max("at") - min("at")), 6) END AS per_hour FROM b GROUP BY file_id""")
def log_summary(spark, d):
    return sidecars.batch_summary(_log(spark, d))


@query("RUN_EVENTS", sql="""SELECT task_id, phase, type, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, array_to_string(list_sort(list(seq))[1:3], ',') AS samples FROM run_events GROUP BY ALL""")
def risk_rollup(spark, d):
    return quality.risk_rollup(A.run_events(spark, d)).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query("CUES", "MEMORY", sql="""WITH h AS (SELECT ('0x' || substr(md5(content_hash || chr(31) || target_text || chr(31) || stage), 1, 15))::BIGINT AS h FROM tm)
SELECT count(*) AS rows, sum(h % 2147483648)::BIGINT AS sum, bit_xor(h) AS xor FROM h""")
def tm_fingerprint(spark, d):
    return memory.fingerprint(A.memory(spark, d), ["content_hash", "target_text", "stage"])


# -- streams ---------------------------------------------------------------------------------------------

def _stream(spark, d):
    """Run events as a stream over the table's files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(d if d.endswith("/events.parquet") else f"{d}/events.parque[t]")
    kind = F.create_map(*(F.lit(x) for x in ("view", "phase_progress", "click", "heartbeat", "error", "error", "purchase", "phase_finished", "signup", "phase_started")))
    return raw.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind[F.col("event_type")].alias("type"), F.concat(F.lit("phase"), (F.col("event_id") % 3).cast("string")).alias("phase"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", *A.event_names())


@query("RUN_EVENTS", sql="""WITH m AS (SELECT task_id, max(seq) AS seq, count(*) AS events, count(*) FILTER (type = 'error') AS errors FROM run_events GROUP BY task_id)
SELECT m.*, e.type, e.phase, e.k FROM m JOIN run_events AS e ON e.task_id = m.task_id AND e.seq = m.seq""")
def events_progress(spark, d):
    return R.drained(R.progress(_stream(spark, d)), folder(spark, "progress"), "complete")


@query("RUN_EVENTS", sql="""WITH g AS (SELECT task_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS b FROM run_events),
s AS (SELECT *, sum(b::INT) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT task_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS events FROM s GROUP BY task_id, k""")
def events_stall_sessions(spark, d):
    return R.drained(R.stalls(_stream(spark, d), "6 hours"), folder(spark, "stalls"), "complete")


@query("RUN_EVENTS", sql="SELECT ts::DATE::TIMESTAMP AS window_start, type, count(*) AS n, round(sum(value), 4) AS value FROM run_events GROUP BY ALL")
def events_daily(spark, d):
    return R.drained(R.windowed_counts(_stream(spark, d)), folder(spark, "daily"), "complete").withColumn("value", F.round("value", 4))


@query("RUN_EVENTS", sql="SELECT DISTINCT task_id, type, phase, file, message FROM run_events WHERE type = 'error'")
def events_dedup(spark, d):
    rows = R.drained(R.distinct_risks(_stream(spark, d), "60 days"), folder(spark, "risks"))
    return rows.select("task_id", "type", "phase", "file", "message")


_RUNS = """WITH r AS (SELECT *{columns} FROM run_events{only}), w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS at FROM r),
g AS (SELECT *, coalesce(ts - lag(ts) OVER ({key} ORDER BY ts, seq) > INTERVAL 6 HOUR, true) AS b FROM r),
s AS (SELECT *, sum(b::INT) OVER ({key} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS no FROM g)
"""


@query("RUN_EVENTS", sql=_RUNS.format(columns="", only=" WHERE type = 'error'", key="PARTITION BY phase, file, message") + """,
n AS (SELECT *, row_number() OVER run AS nth, count(*) OVER (PARTITION BY phase, file, message, no) AS seen, max(ts) OVER (PARTITION BY phase, file, message, no) AS last FROM s WINDOW run AS (PARTITION BY phase, file, message, no ORDER BY ts, seq))
SELECT phase, file, message, ts, seq, nth::INTEGER AS nth, seen, greatest(seen - 3, 0) AS suppressed FROM n, w WHERE nth <= 3 AND last + INTERVAL 6 HOUR < w.at""")
def events_capped(spark, d):
    """The first three risks of a kind, and how many more came until it was quiet for six hours."""
    with sessions.timed_state(spark):
        rows = sessions.capped_risks(_stream(spark, d).filter("type = 'error'"), 3, "6 hours", keys=("phase", "file", "message"))
        return R.drained(rows, folder(spark, "capped"))


@query("RUN_EVENTS", sql=_RUNS.format(columns="", only="", key="PARTITION BY task_id") + """,
e AS (SELECT task_id, no, min(ts) AS start, max(ts) AS last FROM s GROUP BY ALL)
SELECT task_id, 'stalled' AS state, last + INTERVAL 6 HOUR AS at FROM e, w WHERE last + INTERVAL 6 HOUR < w.at
UNION ALL SELECT task_id, 'resumed', start FROM e, w WHERE no > 1 AND start < w.at""")
def events_stall_alarms(spark, d):
    """Alarms of tasks that are silent for six hours, and their end."""
    with sessions.timed_state(spark):
        return R.drained(sessions.stall_alarms(_stream(spark, d), "6 hours", forget="3650 days"), folder(spark, "alarms"))


@query("RUN_EVENTS", sql="SELECT task_id, file, CASE WHEN bool_or(type = 'phase_finished') THEN 'done' ELSE 'running' END AS state, max(seq) AS seq FROM run_events GROUP BY ALL")
def events_files(spark, d):
    return R.drained(R.file_states(_stream(spark, d), "phase_finished"), folder(spark, "files"), "complete")


@query("RUN_EVENTS", sql="SELECT ts::DATE::TIMESTAMP AS window_start, type AS term, sum(k)::BIGINT AS candidates, count(*) FILTER (value > 150) AS conflicts FROM run_events GROUP BY ALL")
def watch_daily(spark, d):
    one = F.create_map("type", F.struct(F.col("k").alias("candidates"), (F.col("value") > 150).cast("long").alias("conflicts")))
    return R.drained(R.watch_totals(_stream(spark, d).select("ts", one.alias("per_term"))), folder(spark, "watch"), "complete")


@query("RUN_EVENTS", sql="SELECT phase, k AS done, count(*) AS n FROM run_events GROUP BY ALL")
def legacy_lines(spark, d):
    """Old progress lines 'Stage X: n/m' become events."""
    lines = A.run_events(spark, d).select(F.concat(F.lit("Stage "), "phase", F.lit(": "), F.col("k").cast("string"), F.lit("/100")).alias("value"))
    events, _ = R.parse_events(lines)
    return events.filter("payload['total'] = '100'").groupBy("phase", F.col("payload")["done"].cast("long").alias("done")).agg(F.count(F.lit(1)).alias("n"))


@query("CUES", sql="SELECT file_id, pos, idx, start_ms, end_ms, text FROM cues")
def file_intake(spark, d):
    """Cue files written one per file_id, picked up as a stream and parsed."""
    base = folder(spark, "intake")
    S.write_srt(A.cues(spark, d), f"{base}/in", S.SPREAD)
    stream = R.arriving_files(spark, f"{base}/in", "*.txt").select(F.regexp_extract("path", r"file_id=(\d+)", 1).cast("long").alias("file_id"), "content")
    return S.parse_srt(R.drained(stream, f"{base}/out"))


@query("CUES", sql="SELECT file_id, pos, idx, start_ms, end_ms, text FROM cues")
def cue_source_files(spark, d):
    """Cue files read by the data source, decoded and parsed."""
    base = folder(spark, "source")
    S.write_srt(A.cues(spark, d), f"{base}/in", S.SPREAD)
    files = S.decode(cue_source.cue_files(spark, f"{base}/in", pattern="*.txt", shares=cue_source.shares_of(spark)).filter("error is null").drop("error"))
    return S.parse_srt(files.select(F.regexp_extract("path", r"file_id=(\d+)", 1).cast("long").alias("file_id"), F.col("text").alias("content")))


@query("PAIRS", sql="SELECT source_text, count(*) AS n FROM pairs GROUP BY ALL")
def learn_stream(spark, d):
    """Pairs that arrive as a stream go through a merge per micro-batch."""
    base = folder(spark, "learn")
    A.pairs(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    R.learn_stream(stream, lambda batch, k: batch.groupBy("source_text").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{base}/out/batch={k}"), f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("source_text").agg(F.sum("n").alias("n"))


@query("CUES", "MEMORY", "PAIRS", sql=r"""
WITH b0 AS (SELECT trim(regexp_replace(source_text, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS source_text, trim(regexp_replace(target_text, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS target_text, created_at, source_name, conv_id * 1000 + turn AS ord FROM pairs
  UNION ALL SELECT source_text, 'again ' || target_text, TIMESTAMP '2025-01-01', NULL, -id FROM tm WHERE stage = 1),
b AS (SELECT substr(sha256(source_text), 1, 32) AS content_hash, 1 AS stage, arg_max(source_text, ord) AS source_text, arg_max(target_text, ord) AS target_text, arg_min(created_at, ord) AS created_at, arg_max(source_name, ord) FILTER (source_name IS NOT NULL) AS source_name
  FROM b0 WHERE source_text <> '' AND target_text <> '' GROUP BY 1)
SELECT coalesce(tm.id, (SELECT max(id) FROM tm) + row_number() OVER (PARTITION BY tm.id IS NULL ORDER BY content_hash, stage)) AS id, content_hash, stage, coalesce(b.source_text, tm.source_text) AS source_text, coalesce(b.target_text, tm.target_text) AS target_text,
  length(coalesce(b.source_text, tm.source_text)) AS char_count, coalesce(tm.created_at, b.created_at) AS created_at, coalesce(tm.hit_count, 0) AS hit_count, coalesce(b.source_name, tm.source_name) AS source_name, 'ja' AS source_lang, 'zh' AS target_lang
FROM tm FULL JOIN b USING (content_hash, stage)""")
def tm_learned(spark, d):
    """Pairs that arrive as a stream are merged into the memory's versions; the stream's batch comes twice."""
    base = folder(spark, "learned")
    tm = settled(A.memory(spark, d))
    again = tm.filter("stage = 1").select("source_text", F.concat(F.lit("again "), "target_text").alias("target_text"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("source_name"), (-F.col("id")).alias("ord"))
    arrived = A.pairs(spark, d).select("source_text", "target_text", "created_at", "source_name", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord")).unionByName(again).withColumn("stage", F.lit(1))
    arrived.write.parquet(f"{base}/in")
    snapshots.create(tm, f"{base}/memory")
    stream = spark.readStream.schema(arrived.schema).parquet(f"{base}/in")
    for state in ("first", "again"):  # a new state folder makes the stream send its batch again
        snapshots.learn(stream, f"{base}/memory", "pairs", f"{base}/{state}").awaitTermination()
    snapshots.compact(spark, f"{base}/memory")
    return snapshots.read(spark, f"{base}/memory")


@query("RUN_EVENTS", sql="SELECT task_id, seq, type FROM run_events WHERE k % 10 <> 9")
def event_lines(spark, d):
    """Events written as protocol lines, some broken, and parsed again."""
    e = A.run_events(spark, d)
    good = F.to_json(F.struct(F.lit(1).alias("protocol_version"), "task_id", "seq", F.col("ts").alias("timestamp"), "type", "phase", F.create_map(F.lit("k"), F.col("k").cast("string")).alias("payload")))
    lines = e.select(F.when(F.col("k") % 10 == 9, F.concat(F.lit("x"), good)).otherwise(good).alias("value"))
    events, _ = R.parse_events(lines)
    return events.select("task_id", "seq", "type")
