"""Validation of target texts and admission to the memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans.containment import containing_in


#: Characters beside Latin letters that don't make a row Chinese or Japanese, characters that do, and particles that make
#: a short row Japanese (fixed values).
_PLAIN = T.BLANK[1:-1] + r"\p{Nd}.,!?'\"\-:;()/"
_CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{31f0}-\x{31ff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
_PARTICLE = "[はがをにでともねよか]|から|まで|へ"


def valid_target(c: Column, target: str, whitelist: str | None = None) -> Column:
    """The text looks like its target language (zh or chinese, en or english, else ja). Empty rows pass: whether they may
    be empty is decided elsewhere. whitelist is a pattern of short Japanese texts that always pass; a project brings it."""
    s = T.strip(F.coalesce(c, F.lit("")))
    lang = {"chinese": "zh", "zh": "zh", "english": "en", "en": "en"}.get(target, "ja")
    kana, han = s.rlike(T.KANA), s.rlike(r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]")
    latin = s.rlike("[A-Za-z]")
    verdict = F.when(s == "", True)
    if lang == "zh":
        verdict = verdict.when(F.contains(s, F.lit(" ||| ")), False)
    if lang == "ja" and whitelist is not None:
        verdict = verdict.when(s.rlike(whitelist), True)
    verdict = verdict.when(s.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), False)
    if lang == "en":
        return verdict.otherwise(~kana & latin)
    wide = r"\x{3000}-\x{303f}\x{ff01}-\x{ff60}\x{ffe0}-\x{ffe6}"
    verdict = verdict.when(s.rlike(f"^[A-Za-z{_PLAIN}\\\\]+$"), False).when(latin & s.rlike(f"^[A-Za-z{_PLAIN}\\\\{wide}]+$"), False).when(~s.rlike(_CJK), False)
    if lang == "ja":
        verdict = verdict.when(s.rlike(_PARTICLE), True).when(s.rlike(f"^{T.KANA}{{1,2}}[。！？,.]?$"), False)
        verdict = verdict.when(s.rlike(f"^{T.HAN}{{1,6}}[。！？,.]?$"), True).when(s.rlike(f"^{T.HAN}{{1,3}}[,{T.BLANK[1:-1]}]*[A-Za-z]"), False)
    else:
        verdict = verdict.when(~han & kana, False)
    return verdict.otherwise(True)


def language_filter(rows: DataFrame, invalid: Column, valve: float = 0.5) -> DataFrame:
    """invalid and dropped: invalid rows go unless more than valve of the file would."""
    whole = Window.partitionBy("file_id")
    out = rows.withColumn("invalid", F.coalesce(invalid, F.lit(False)))
    share = F.avg(F.col("invalid").cast("double")).over(whole)
    return out.withColumns({"share": share}).withColumn("dropped", F.col("invalid") & (F.col("share") <= valve)).drop("share")


def language_mark(rows: DataFrame, invalid: Column, valve: float = 0.5) -> DataFrame:
    """As language_filter, but rows stay and are marked as untranslated."""
    out = language_filter(rows, invalid, valve)
    return out.withColumn("text", F.when(F.col("dropped"), F.concat(F.lit(T.UNTRANSLATED + " "), "text")).otherwise(F.col("text")))


def mistranslations(pairs: DataFrame, rules: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """pairs (file_id, idx, source, target) against rules (name, source pattern, target pattern, replacement or None):
    warnings by name, and the target with the safe replacements made. Rules are few and given."""
    fixed, names = F.col("target"), []
    for name, src, tgt, new in rules:
        hit = F.col("source").rlike(src) & F.col("target").rlike(tgt)
        if new is None:
            names.append(F.when(hit, F.lit(name)))
        else:
            fixed = F.when(hit, F.regexp_replace(fixed, tgt, new)).otherwise(fixed)
    return pairs.withColumns({"fixed": fixed, "warnings": F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")})


def learn_defect(source: Column, target: Column) -> Column:
    """Why a pair must not be learnt, the first reason of six, else null: left untranslated, marks of a reply's format,
    kana left, the source with a translation behind it, a placeholder, or a length ratio out of bounds."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    ratio = T.weighted_length(t) / T.weighted_length(s)
    return (
        F.when(T.is_untranslated(t), "untranslated").when(F.contains(t, F.lit("Translation")), "leak").when((t != s) & t.rlike(r"[\x{3040}-\x{30ff}\x{ff66}-\x{ff9f}]"), "kana")
        .when((F.length(t) > F.length(s)) & F.startswith(t, F.substring(s, F.lit(1), F.greatest(F.lit(1), F.length(s) - 1))), "src_prefix")
        .when(F.contains(t, F.lit("无对应条目")), "placeholder").when((T.weighted_length(s) >= 4) & ((ratio < 0.25) | (ratio > 8)), "len_ratio")
    )


def learn_admission(final: DataFrame, orig: DataFrame, flagged: dict[str, DataFrame]) -> DataFrame:
    """Rows aligned by exact span with the reason they aren't learnt: no_pair (a side is empty, untranslated or both are
    equal), a flag (frames of file_id, idx, in order of precedence), then a defect; null means admitted."""
    src = orig.groupBy("file_id", "start_ms", "end_ms").agg(F.min_by(T.strip(F.coalesce("text", F.lit(""))), "pos").alias("source"))
    rows = final.join(src, ["file_id", "start_ms", "end_ms"])
    target = T.strip(F.coalesce("text", F.lit("")))
    reason = [F.when((F.col("source") == "") | (target == "") | T.is_untranslated(target) | (target == F.col("source")), "no_pair")]
    for name, df in flagged.items():
        rows = rows.join(df.select("file_id", "idx").distinct().withColumn(name, F.lit(name)), ["file_id", "idx"], "left")
        reason.append(F.col(name))
    rows = rows.withColumn("reason", F.coalesce(*reason, learn_defect(F.col("source"), target)))
    return rows.drop(*flagged)


def retranslation_gate(new: Column, old: Column, target: str = "zh") -> Column:
    """Why a retranslation is refused, else null."""
    n, o = T.strip(F.coalesce(new, F.lit(""))), T.strip(F.coalesce(old, F.lit("")))
    return F.when(n == "", "empty").when(n == o, "unchanged").when(~T.fluent(n, target), "not_fluent")


def apply_retranslations(final: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new rows with the accepted texts (file_id, pos, new_text), and their violations(); none may occur."""
    new = accepted.groupBy("file_id", "pos").agg(F.first("new_text").alias("new_text"))
    out = final.join(new, ["file_id", "pos"], "left")
    out = out.withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
    return out, violations(final, out, new)


def violations(old: DataFrame, new: DataFrame, selected: DataFrame) -> DataFrame:
    """Places where a new version breaks what a retranslation must keep: row_count (a row came or went), timing (its span
    changed), text (it changed though the row wasn't selected)."""
    side = lambda df, p: df.select("file_id", "pos", F.lit(True).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("start_ms", "end_ms", "text")))
    chosen = selected.select("file_id", "pos").distinct().withColumn("chosen", F.lit(True))
    both = side(old, "a").join(side(new, "b"), ["file_id", "pos"], "full_outer").join(chosen, ["file_id", "pos"], "left")
    moved = ~(F.col("a_start_ms").eqNullSafe(F.col("b_start_ms")) & F.col("a_end_ms").eqNullSafe(F.col("b_end_ms")))
    touched = F.col("chosen").isNull() & ~F.col("a_text").eqNullSafe(F.col("b_text"))
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "row_count").when(moved, "timing").when(touched, "text")
    return both.select("file_id", "pos", kind.alias("violation")).filter("violation is not null")


def selected_items(items: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Guide items to act on: the listed ones (file_id, idx), or without a list those open with a current text."""
    return items.filter("status = 'open' and current_text is not null") if wanted is None else items.join(wanted.select("file_id", "idx").distinct(), ["file_id", "idx"], "left_semi")


def replied_rows(rows: DataFrame) -> DataFrame:
    """Rows of a reply with the lines gone that comment on the work; rows that are empty then, or stand for a deleted one,
    go too."""
    return rows.withColumn("text", T.strip_chatter(F.col("text"))).filter((F.col("text") != "") & ~T.is_placeholder(F.col("text")))


def full_sources(items: DataFrame, source: DataFrame) -> DataFrame:
    """Items with the whole source text of their exact span: the first row of the span, null where there is none."""
    first = source.groupBy("file_id", "start_ms", "end_ms").agg(F.min_by("text", "pos").alias("source_text"))
    return items.join(first, ["file_id", "start_ms", "end_ms"], "left")


def verified_pairs(pairs: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed terms (file_id, src, dst; no empty sides) whose sides both occur in a row of the file (texts: file_id, pos,
    source, target), differ, and are new. A pair meets the rows of its own file only."""
    pairs = pairs.filter("src <> dst and src <> '' and dst <> ''").select("file_id", "src", "dst").distinct()
    held = containing_in(texts.select("file_id", "source", "target"), pairs, "file_id", lambda x: F.contains("source", x["src"]) & F.contains("target", x["dst"]))
    new = held.select("src", "dst").distinct().withColumn("key", F.lower("src"))
    return new.join(known.select(F.lower("src").alias("key")).distinct(), "key", "left_anti").drop("key")
