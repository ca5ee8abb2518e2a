"""Merging fragments of cues. Files are cut at pauses that no merge crosses, and each small island is folded in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans.islands import by_file, contains_join, island
from cuelake.plans.once import once

#: Endings and beginnings of unfinished and finished rows (fixed patterns).
PARTICLE_END = r"(?:は|が|を|に|で|て|し|から|ので|って|けど|けども|ー)\s*$"
OPEN_START = r"^(?:あの|その|えっと|なんか|でも|だから|それで|そして|つまり|けど|が|で|ちょっと|でもね|それでね)"
COMPLETE_END = r"(?:です|ます|んだ|のだ|よね|ない|た|だ|か[。？?]?|[。！？?！])\s*$"
PAUSE_END = r"(?:…|⋯|〜|~)\s*$"
OPEN_PUNCTUATION = r"(?:，|、|:|：|——|,)$"
_CONNECTORS = ("但是", "可是", "不过", "所以", "因为", "而且", "然后", "那么", "如果", "虽然")
CONNECTOR = f"^(?:{'|'.join(_CONNECTORS)})$"
_MARKS = r"[，。、！？\s,\.!?…~～]"
#: A connector with marks anywhere: CONNECTOR without taking the marks out first.
_BARE_CONNECTOR = f"^{_MARKS}*(?:{'|'.join(f'{_MARKS}*'.join(w) for w in _CONNECTORS)}){_MARKS}*$"

_CUR = "struct<start_ms:bigint,end_ms:bigint,text:string,n:int,pos:int,idx:bigint,last:string>"


def fold_rows(cues: DataFrame, gap_ms: int, allow: Callable[[Column, Column], Column], glue: str, may: Column | None = None) -> DataFrame:
    """Rows of each island joined while allow(current, next) holds; members is how many rows became one. may holds for rows
    that can take a next one, where that shows in the row alone: islands end behind all others, and most are a row."""
    w = by_file()
    breaks = F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms
    if may is not None:
        cues, breaks = once(cues, _may=may), breaks | ~F.lag("_may").over(w)
    rows = cues.withColumn("_island", island(F.coalesce(breaks, F.lit(True)), w))
    own = F.struct(F.col("pos").cast("int").alias("pos"), F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text"))
    groups = rows.groupBy("file_id", "_island").agg(F.sort_array(F.collect_list(own)).alias("a"))

    def row(x):
        return F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text"), F.lit(1).alias("n"), x["pos"].alias("pos"), x["idx"].alias("idx"), x["text"].alias("last")).cast(_CUR)

    def step(acc, item):
        cur, x = acc["cur"], row(item)
        merged = F.struct(cur["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), F.concat(cur["text"], F.lit(glue), x["text"]).alias("text"), (cur["n"] + 1).alias("n"), cur["pos"].alias("pos"), cur["idx"].alias("idx"), x["text"].alias("last")).cast(_CUR)
        ok = F.coalesce(cur.isNotNull() & allow(cur, x), F.lit(False))
        done = F.when(ok | cur.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))
        return F.struct(done.alias("done"), F.when(ok, merged).otherwise(x).alias("cur")).cast(f"struct<done:array<{_CUR}>,cur:{_CUR}>")

    start = F.struct(F.array().cast(f"array<{_CUR}>").alias("done"), F.lit(None).cast(_CUR).alias("cur"))
    folded = F.aggregate("a", start, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    out = groups.select("file_id", F.explode(F.when(F.size("a") == 1, F.array(row(F.col("a")[0]))).otherwise(folded)).alias("m"))
    return out.select("file_id", "m.pos", "m.idx", "m.start_ms", "m.end_ms", "m.text", F.col("m.n").alias("members"))


def merge_fragments(cues: DataFrame, gap_ms: int = 500, most: int = 3, span_ms: int = 8000) -> DataFrame:
    """Target side: a row that ends open, or is a bare connector, takes the next one."""
    def allow(cur, x):
        bare = F.regexp_replace(cur["last"], _MARKS, "")
        return (cur["n"] < most) & (x["end_ms"] - cur["start_ms"] <= span_ms) & (cur["last"].rlike(OPEN_PUNCTUATION) | bare.rlike(CONNECTOR))

    own = F.coalesce("text", F.lit(""))
    ending = F.substring(own, -4, 4)  # the longest ending and a line break
    return fold_rows(cues, gap_ms, allow, " ", ending.rlike(OPEN_PUNCTUATION) | own.rlike(_BARE_CONNECTOR))


def premerge(cues: DataFrame, most: int = 3, span_ms: int = 5000, chars: int = 80, fragment: int = 6) -> DataFrame:
    """Source side: rows that recognition cut apart. Gaps are compared in seconds as doubles, as the limits are."""
    def allow(cur, x):
        prev, text = T.strip(cur["text"]), T.strip(x["text"])
        core = T.strip_pause(prev)
        gap = x["start_ms"] / 1000.0 - cur["end_ms"] / 1000.0
        ended, follows = prev.rlike(COMPLETE_END), text.rlike(COMPLETE_END)
        wanted = ((gap <= 1.0) & core.rlike(PARTICLE_END)) | ((gap <= 0.5) & (text.rlike(OPEN_START) | (~core.rlike(COMPLETE_END) & (F.length(text) < fragment))))
        veto = (prev.rlike(PAUSE_END) & (follows | text.rlike(PAUSE_END))) | (ended & follows & (gap > 0.2))
        fits = (x["end_ms"] - cur["start_ms"] <= span_ms) & (F.length(prev) + F.length(text) <= chars) & (cur["n"] < most)
        return (prev != "") & (text != "") & wanted & ~veto & fits

    trimmed = cues.withColumn("text", T.strip(F.coalesce("text", F.lit(""))))
    return fold_rows(trimmed, 1001, allow, "")


def evidence(merged: DataFrame, cues: DataFrame, source: DataFrame) -> DataFrame:
    """Merged rows with the source texts of every row before the merge that lies in their span, with 1 ms of play: all texts
    of the source rows that have such a row's exact span."""
    span, own = ["file_id", "start_ms", "end_ms"], [c for c in merged.columns if c not in ("file_id", "pos", "start_ms", "end_ms")]
    spans = source.groupBy(*span).agg(F.lit(1).alias("n"), F.collect_list("text").alias("src")).join(cues.select(*span), span, "left_semi")
    pairs = contains_join(merged, spans, ["file_id"], how="left")  # rows of one merged span
    texts = F.when(F.max("r_n") == 1, F.array_sort(F.flatten(F.collect_list("r_src"))))
    return pairs.groupBy("file_id", "pos", "start_ms", "end_ms").agg(*(F.first(c).alias(c) for c in own), texts.alias("evidence")).select(*merged.columns, "evidence")
