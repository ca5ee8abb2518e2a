"""Human and model review: sampling, verdicts, evidence, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans.ranks import ranked

VERDICT = "array<struct<row:int,category:int,side:string,evidence_timing:string,evidence_pass:string,confidence:string,reason:string>>"
#: What a verdict may name (fixed values).
PASSES, CONFIDENCES = ("pass1", "pass2"), ("high", "medium", "low")
#: The mark of a verdict that a person must look at (a fixed format).
MANUAL = "[需人工复核]"


def review_filter(rows: DataFrame, groups: list[str], most: float) -> DataFrame:
    return rows.filter(F.col("group").isin(*groups) & (F.col("similarity") <= most))


def round_robin(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows of every file, then the second ones and so on, n in all. A sample is the feature here."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(*(order or ("pos",))))
    return rows.withColumn("place", place).orderBy("place", "file_id").limit(n)


def verdicts(replies: DataFrame, expected: DataFrame) -> DataFrame:
    """One verdict per expected row (batch, row): parsed from a reply with a JSON array in it, the first valid one of a
    row; missing rows get category 4 with low confidence, and filled says so. A verdict is valid with a category, a reason, a
    known confidence, and sides that are a pass or null."""
    parsed = replies.select("batch", F.posexplode(F.from_json(T.first_json(F.col("body")), VERDICT)).alias("at", "v")).select("batch", "at", "v.*")
    named = lambda c: F.col(c).isNull() | F.col(c).isin(*PASSES)
    good = parsed.filter(F.col("category").between(1, 5) & F.col("reason").isNotNull() & named("side") & named("evidence_pass") & F.col("confidence").isin(*CONFIDENCES))
    first = good.withColumn("k", F.row_number().over(Window.partitionBy("batch", "row").orderBy("at"))).filter("k = 1").drop("k", "at")
    rows = expected.join(first, ["batch", "row"], "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.withColumns({
        "filled": F.col("category").isNull(), "category": F.coalesce("category", F.lit(4)), "confidence": F.coalesce("confidence", F.lit("low")),
        "evidence_timing": text(F.col("evidence_timing")), "reason": T.strip(text(F.col("reason"))),
    })


def verify_evidence(rows: DataFrame, support: dict[str, str] | None = None, tolerance_ms: int = 1000) -> DataFrame:
    """verify of verdicts beside window, the rows (start_ms, text) around the row in the pass that the evidence names:
    N/A for all categories but 1; PASS when the first cited time lies within the tolerance of a row's start and every
    cited Japanese fragment stands in a row; else FAIL, also where side, pass or time are missing or the reason supports
    the other side. A FAIL, and a reason for both sides, make the confidence low; the latter is marked for a person.
    support: patterns of a side's name and of a supportive phrase, a project's own."""
    target = F.get(T.evidence_times(F.col("evidence_timing")), F.lit(0))
    timed = F.exists(F.coalesce("window", F.array().cast("array<struct<start_ms:bigint,text:string>>")), lambda x: F.abs(x["start_ms"] - target) <= tolerance_ms)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, T.BLANK, ""), "^…+|…+$", "")
    quoted = F.forall(cited_fragments(F.col("reason")), lambda x: F.exists("window", lambda row: F.contains(bare(row["text"]), bare(x))))
    verdict = contradiction(F.col("reason"), F.col("side"), support) if support else F.lit("")
    missing = F.coalesce(F.col("side"), F.lit("")).eqNullSafe("") | (F.coalesce(F.col("evidence_pass"), F.lit("")) == "") | target.isNull()
    verify = F.when(F.col("category") != 1, "N/A").when((verdict == "FAIL") | missing, "FAIL").when(F.coalesce(timed, F.lit(False)) & F.coalesce(quoted, F.lit(False)), "PASS").otherwise("FAIL")
    both = (F.col("category") == 1) & (verdict == "LOW_FLAG")
    rows = rows.withColumns({"verify": verify, "_both": both})
    low = (F.col("verify") == "FAIL") | F.col("_both")
    marked = F.when(F.col("_both") & ~F.startswith("reason", F.lit(MANUAL)), F.concat(F.lit(MANUAL), "reason")).otherwise(F.col("reason"))
    return rows.withColumns({"confidence": F.when(low, "low").otherwise(F.col("confidence")), "reason": marked}).drop("_both")


def cited_fragments(reason: Column) -> Column:
    """Quoted pieces of 4 to 40 characters with kana in them, ellipses off their ends."""
    groups = F.regexp_extract_all(F.coalesce(reason, F.lit("")), F.lit(r"「[^「」]*」|『[^『』]*』|“[^“”]*”|‘[^‘’]*’|'[^'\n]*'|\"[^\"\n]*\""), 0)
    inner = F.transform(groups, lambda x: T.strip(F.regexp_replace(T.strip(F.substring(x, F.lit(2), F.length(x) - 2)), "^…+|…+$", "")))
    return F.filter(inner, lambda x: F.length(x).between(4, 40) & x.rlike(r"[\x{3041}-\x{309a}\x{30a1}-\x{30fa}]"))


def contradiction(reason: Column, side: Column, support: dict[str, str]) -> Column:
    """FAIL when clauses of the reason support the other side only, LOW_FLAG when they support both, else empty. support
    maps each side's name to the pattern of its mention, and "phrases" to the pattern of supportive phrases, which
    don't count right behind a negation."""
    clauses = F.split(F.coalesce(reason, F.lit("")), "[。；！？\n]")
    praised = f"(?<![不非未无])(?:{support['phrases']})"
    said = {name: F.exists(clauses, lambda x: x.rlike(mention) & x.rlike(praised)) for name, mention in support.items() if name != "phrases"}  # noqa: B023
    own, other = F.lit(False), F.lit(False)
    for name, found in said.items():
        own, other = own | ((side == name) & found), other | ((side != name) & found)
    return F.when(side.isNull() | (side == ""), "").when(other & ~own, "FAIL").when(other & own, "LOW_FLAG").otherwise("")


def film_stats(rows: DataFrame, classes: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Per film: must-see rows in all and reviewed, reviewed rows by category, the estimated share of true problems
    (categories 1 and 2 over must-see rows, null without any) and rows of high confidence (1 or 2, verified). rows are
    all rows of the films with group; category is null where a row wasn't reviewed."""
    must = F.col("group") == "must_see"
    counts = [F.count_if(F.col("category") == k).alias(f"c{k}") for k in classes]
    out = rows.groupBy("film").agg(F.count_if(must).alias("must_total"), F.count_if(must & F.col("category").isNotNull()).alias("must_done"), *counts, F.count_if(F.col("category").isin(1, 2) & (F.col("verify") == "PASS")).alias("high"))
    return out.withColumn("problem_rate", F.when(F.col("must_total") > 0, (F.col("c1") + F.col("c2")) / F.col("must_total")))


def usage_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Calls (rows, prompt_tokens, completion_tokens, elapsed_s; nulls count nothing) in sum, with tokens and seconds per row;
    0 without rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("total_calls"), total("rows").alias("total_rows"), total("prompt_tokens").alias("total_prompt_tokens"), total("completion_tokens").alias("total_completion_tokens"), total("elapsed_s").alias("elapsed"))
    each = lambda c, digits: F.when(F.col("total_rows") > 0, F.bround(c / F.col("total_rows"), digits)).otherwise(0.0)
    return out.select(*by, "total_calls", "total_rows", "total_prompt_tokens", "total_completion_tokens", each(F.col("total_prompt_tokens") + F.col("total_completion_tokens"), 1).alias("tokens_per_row"), F.bround("elapsed", 3).alias("total_elapsed_s"), each(F.col("elapsed"), 3).alias("avg_s_per_row"))


def review_order(rows: DataFrame, films: DataFrame) -> DataFrame:
    """place of every row: films that are reviewed whole by their share of true problems, the others by their must-see rows,
    most first; in a film by category, verified rows first, similarity and time. Places are counted by film."""
    done = (F.col("must_total") > 0) & (F.col("must_done") >= F.col("must_total"))
    key = F.when(done, F.col("problem_rate")).otherwise(F.col("must_total").cast("double"))
    places = ranked(films.withColumn("_key", key), "film_rank", F.desc("_key"), F.col("film")).select("film", F.col("film_rank").cast("int").alias("film_rank"))
    w = Window.partitionBy("film").orderBy("category", F.when(F.col("verify") == "PASS", 0).otherwise(1), "similarity", F.greatest("start_ms", F.lit(0)), "pos")
    return rows.join(places, "film").withColumn("place", F.row_number().over(w))


def action_status(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Guide items as observation, applied (open, and their timing is in the ledger), open, or closed."""
    done = ledger.select("file_id", "timing").distinct().withColumn("done", F.lit(True))
    rows = items.join(done, ["file_id", "timing"], "left")
    state = F.when(F.col("status") == "observation", "observation").when(F.col("status") != "open", "closed").when(F.col("done"), "applied").otherwise("open")
    return rows.withColumn("state", state).drop("done")


def action_counts(items: DataFrame) -> DataFrame:
    """Per file and category the rows of action_status() that are open, applied and observations."""
    return items.groupBy("file_id", "category").agg(*(F.count_if(F.col("state") == k).alias(k) for k in ("open", "applied", "observation")))


def detections(items: DataFrame) -> DataFrame:
    """Guide items that have a place in time."""
    return items.filter(T.strip(F.coalesce("timing", F.lit(""))) != "")


def with_review_rows(path_rows: DataFrame) -> DataFrame:
    """Rows of a review table as text columns, typed: filtered rows go, numbers that aren't numbers count as 0."""
    rows = path_rows.filter(~F.coalesce(F.col("group"), F.lit("")).eqNullSafe("artifact"))
    return rows.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("similarity", "iou", "offset_s")})
