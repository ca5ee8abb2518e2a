"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results meet in a hash join on conversation and identifier. Calls are put in topological order of the
results they depend on, by rounds that settle every call whose dependencies are settled. In each round a call that
waits for a single other one also hands its waiting on, so a chain takes rounds by the logarithm of its length. Arguments are parsed to
variants and checked against the tool's schema; each linked call is serialised as canonical JSON: keys sorted at
every depth, no white space.

Edge cases: of several calls (or results) with an identifier the first turn counts, then the smallest text; calls
without a result, results without a call, unknown tools, broken JSON and null arguments are kept and named in
problems; dependencies on unknown calls don't order anything and are named; calls on a cycle have no level and
come last; null identifiers link with nothing; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import durable

#: tool -> parameter -> (JSON type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
_TURNS = 256


def problems_of(name: Column, arguments: Column, parsed: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, as an array of strings in order."""
    found = [F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool")), F.when(parsed.isNull(), F.lit("arguments aren't JSON"))]
    keys = F.json_object_keys(arguments)
    for tool, params in sorted(schemas.items()):
        own = (name == tool) & parsed.isNotNull()
        for param, (kind, required) in sorted(params.items()):
            value = F.variant_get(parsed, f"$.{param}", "variant")
            if required:
                found.append(F.when(own & value.isNull(), F.lit(f"{param} is missing")))
            found.append(F.when(own & value.isNotNull() & ~F.schema_of_variant(value).rlike(f"^{_KINDS[kind]}$"), F.lit(f"{param} isn't {kind}")))
        extra = F.filter(keys, lambda k: ~k.isin(*params))
        found.append(F.when(own & (F.size(extra) > 0), F.concat(F.lit("unexpected "), F.array_join(F.sort_array(extra), ", "))))
    return F.array_compact(F.array(*found))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 without dependencies, else one more than the deepest of them; none on or behind a cycle.

    An edge says that a call lies w levels above another at least. A round resolves edges to what the last round
    settled, settles calls without edges, and replaces edges to calls with one edge by edges to what those wait for.
    As long as a call can be settled, a round settles one, so a round without any ends the search."""
    key = ["conv_id", "call_id"]
    edges = durable(edges.select(*key, "dep", F.lit(1).cast("long").alias("w")))
    waiting = durable(calls.join(edges, key, "left_semi").select(*key, F.lit(0).cast("long").alias("base")))
    fresh = durable(calls.join(edges, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")))
    settled = [fresh]
    while fresh.head(1):
        known = fresh.select("conv_id", F.col("call_id").alias("dep"), "level")
        seen = durable(edges.join(known, ["conv_id", "dep"], "left"))
        left = seen.filter("level is null").drop("level")
        told = seen.filter("level is not null").groupBy(*key).agg(F.max(F.col("w") + F.col("level")).alias("m"))
        waiting = durable(waiting.join(told, key, "left").select(*key, F.greatest("base", F.coalesce("m", F.lit(0))).alias("base")))
        fresh = durable(waiting.join(left, key, "left_anti").select(*key, F.col("base").alias("level")))
        settled.append(fresh)
        waiting = waiting.join(left, key, "left_semi")
        single = left.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("next"), F.min("w").alias("more")).filter("n = 1").join(waiting, key)
        single = single.select("conv_id", F.col("call_id").alias("dep"), "next", "more", F.col("base").alias("own"))
        jumped = durable(left.join(single, ["conv_id", "dep"], "left"))
        further = F.least(F.col("w") + F.coalesce("more", F.lit(0)), F.lit(1 << 40))  # on a cycle it grows without end
        edges = durable(jumped.select(*key, F.coalesce("next", "dep").alias("dep"), further.alias("w")).groupBy(*key, "dep").agg(F.max("w").alias("w")))
        passed = jumped.filter("next is not null").groupBy(*key).agg(F.max(F.col("w") + F.col("own")).alias("m"))
        waiting = durable(waiting.join(passed, key, "left").select(*key, F.greatest("base", F.least(F.coalesce("m", F.lit(0)), F.lit(1 << 40))).alias("base")))
    return reduce(DataFrame.union, settled).select(*key, F.col("level").cast("int").alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls: conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of call_ids).
    results: conv_id, call_id, turn, content. Returns a row per call or orphan result, in order_no within the conversation."""
    key = ["conv_id", "call_id"]
    fields = ["turn", "arguments", "name", "depends_on"]
    called = durable(calls.filter("call_id is not null").groupBy(*key).agg(F.min(F.struct(*fields)).alias("c")).select(*key, *(F.col(f"c.{f}").alias(f) for f in fields)))
    answered = results.filter("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r")).select(*key, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    wanted = called.select(*key, F.explode(F.array_distinct("depends_on")).alias("dep")).filter("dep is not null")
    known = called.select("conv_id", F.col("call_id").alias("dep"))
    edges = durable(wanted.join(known, ["conv_id", "dep"], "left_semi"))
    unknown = wanted.join(known, ["conv_id", "dep"], "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("unknown_deps"))
    rows = called.join(answered, key, "full_outer").join(levels(called, edges), key, "left").join(unknown, key, "left")
    parsed = F.try_parse_json("arguments")
    rows = rows.withColumn("parsed", parsed).withColumns({
        "is_call": F.col("turn").isNotNull() | F.col("name").isNotNull() | F.col("arguments").isNotNull(),
        "at": F.coalesce("turn", "result_turn"), "rank": F.coalesce("level", F.lit(1 << 30)),
    })
    more = [F.when(F.col("is_call") & F.col("result_turn").isNull() & F.col("content").isNull(), F.lit("no result")), F.when(~F.col("is_call"), F.lit("no call")), F.when(F.col("result_turn") < F.col("turn"), F.lit("result before call")), F.when(F.col("unknown_deps") > 0, F.lit("unknown dependency")), F.when(F.col("is_call") & F.col("level").isNull(), F.lit("cycle"))]
    checked = F.when(F.col("is_call"), problems_of(F.col("name"), F.col("arguments"), F.col("parsed"), schemas)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("problems", F.concat(checked, F.array_compact(F.array(*more))))
    message = F.struct(F.coalesce(F.col("parsed"), F.when(F.col("arguments").isNotNull(), F.to_variant_object(F.array("arguments")))).alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"), F.col("at").alias("turn"))
    rows = durable(rows.select(*key, F.col("at").alias("turn"), "name", "level", "rank", "problems", F.to_json(message).alias("message")))
    # The place in the conversation, without one task per conversation: first places of runs of turns, then places in the run.
    run = [F.col("conv_id"), F.col("rank"), F.floor(F.coalesce("turn", F.lit(0)) / _TURNS).alias("run")]
    counts = rows.groupBy(*run).agg(F.count(F.lit(1)).alias("n"))
    counts = durable(counts.withColumn("first", F.sum("n").over(Window.partitionBy("conv_id").orderBy("rank", "run")) - F.col("n")).drop("n"))
    place = F.row_number().over(Window.partitionBy("conv_id", "rank", "run").orderBy("turn", "call_id"))
    out = rows.withColumn("run", run[2]).join(counts, ["conv_id", "rank", "run"]).withColumn("order_no", (F.col("first") + place - 1).cast("long"))
    return out.select("conv_id", "call_id", "turn", "name", "level", "order_no", "problems", "message")


#: Tools of the adapter below.
TOOLS: Schemas = {
    "compute": {"chars": ("integer", True), "exact": ("boolean", True)},
    "lookup": {"key": ("string", True), "limit": ("integer", False)},
    "search": {"limit": ("integer", True), "query": ("string", True)},
}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain turns: a user turn asks a tool, the assistant turn after it answers; the call
    depends on the call at half its turn. Some calls break their schema. Texts go whole into arguments and content."""
    text = F.coalesce("text", F.lit(""))
    identifier = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    n = F.length("text")
    rows = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null and turn is not null")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)\A\[|\]\z", "")
    limit = F.when(n % 11 == 0, quoted((n % 7).cast("string"))).otherwise((n % 7).cast("string"))
    arguments = (
        F.when(n % 3 == 0, F.concat(F.lit('{ "query" : '), quoted(text), F.lit(' , "limit": '), limit, F.lit("}")))
        .when(n % 3 == 1, F.concat(F.lit('{"limit":'), limit, F.lit(',  "key": '), quoted(text), F.lit("}")))
        .otherwise(F.concat(F.lit('{"exact":true , "chars":'), n.cast("string"), F.lit("}")))
    )
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("compute")
    calls = rows.filter("role = 'user'").select("conv_id", identifier(F.col("turn")).alias("call_id"), "turn", name.alias("name"), F.coalesce(arguments, F.lit("{}")).alias("arguments"), F.when(F.col("turn") > 1, F.array(identifier(F.floor(F.col("turn") / 2).cast("long")))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = rows.filter("role = 'assistant'").select("conv_id", identifier(F.col("turn") - 1).alias("call_id"), "turn", text.alias("content"))
    return calls, results


def other_turns(conversations: DataFrame) -> DataFrame:
    """The turns that are neither call nor result, as rows of link_calls: they have no identifier and no place in the order."""
    linked = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    problems = F.array_compact(F.array(
        F.when(F.col("conv_id").isNull(), "no conversation"), F.when(F.col("turn").isNull(), "no turn"),
        F.when(F.col("role").isNull(), "no role").when(~linked, F.concat(F.lit("neither call nor result: "), "role")),
    ))
    message = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"))
    rows = conversations.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNull() | F.col("turn").isNull() | ~linked)
    return rows.select("conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("order_no"), problems.alias("problems"), message.alias("message"))


def chat_report(conversations: DataFrame) -> DataFrame:
    out = link_calls(*from_conversations(conversations), TOOLS).unionByName(other_turns(conversations))
    return out.withColumn("problems", F.array_join("problems", "; "))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) AS n, to_json(coalesce(text, '')) AS q FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'compute' END AS name, n,
  CASE WHEN n % 11 = 0 THEN '"' || (n % 7) || '"' ELSE (n % 7)::VARCHAR END AS lim, q,
  CASE WHEN turn > 1 THEN 'call_' || conv_id || '_' || (turn // 2) END AS dep FROM t WHERE role = 'user'),
a AS (SELECT *, CASE n % 3 WHEN 0 THEN '{"limit":' || lim || ',"query":' || q || '}' WHEN 1 THEN '{"key":' || q || ',"limit":' || lim || '}'
  ELSE '{"chars":' || n || ',"exact":true}' END AS args, EXISTS (FROM c AS p WHERE p.conv_id = c.conv_id AND p.call_id = c.dep) AS linked FROM c),
r AS (SELECT conv_id, turn AS result_turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, q AS content FROM t WHERE role = 'assistant'),
v AS (SELECT conv_id, call_id, 0 AS level FROM a WHERE NOT linked
  UNION ALL SELECT a.conv_id, a.call_id, v.level + 1 FROM a JOIN v ON a.conv_id = v.conv_id AND a.dep = v.call_id WHERE a.linked),
j AS (SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.call_id, r.call_id) AS call_id, coalesce(a.turn, result_turn) AS turn, name, level, args, content, result_turn, a.turn AS own, n, lim, dep, linked
  FROM a FULL JOIN r ON a.conv_id = r.conv_id AND a.call_id = r.call_id LEFT JOIN v ON v.conv_id = a.conv_id AND v.call_id = a.call_id)
SELECT conv_id, call_id, turn, name, level, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 1 << 30), turn, call_id) - 1 AS order_no,
  array_to_string(list_filter([CASE WHEN own IS NOT NULL AND n % 3 < 2 AND n % 11 = 0 THEN 'limit isn''t integer' END, CASE WHEN own IS NOT NULL AND result_turn IS NULL THEN 'no result' END,
    CASE WHEN own IS NULL THEN 'no call' END, CASE WHEN dep IS NOT NULL AND NOT linked THEN 'unknown dependency' END], lambda x: x IS NOT NULL), '; ') AS problems,
  '{' || CASE WHEN args IS NOT NULL THEN '"arguments":' || args || ',' ELSE '' END || '"id":"' || call_id || '"' || CASE WHEN name IS NOT NULL THEN ',"name":"' || name || '"' ELSE '' END
    || CASE WHEN content IS NOT NULL THEN ',"result":' || content ELSE '' END || ',"turn":' || turn || '}' AS message
FROM j
UNION ALL SELECT conv_id, NULL, turn, NULL, NULL, NULL,
  array_to_string(list_filter([CASE WHEN conv_id IS NULL THEN 'no conversation' END, CASE WHEN turn IS NULL THEN 'no turn' END,
    CASE WHEN role IS NULL THEN 'no role' WHEN role NOT IN ('user', 'assistant') THEN 'neither call nor result: ' || role END], lambda x: x IS NOT NULL), '; '),
  '{' || array_to_string(list_filter(['"content":' || to_json(text), '"role":' || to_json(role), '"turn":' || turn], lambda x: x IS NOT NULL), ',') || '}'
FROM conversations WHERE conv_id IS NULL OR turn IS NULL OR coalesce(role NOT IN ('user', 'assistant'), true)
"""
