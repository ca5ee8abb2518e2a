"""Text functions. Regular expressions spell out Unicode classes, as Java's \\w and \\s are ASCII."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
#: The characters of BLANK, one by one: translate() drops or changes listed characters without a search.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
KANA = r"[\x{3040}-\x{30ff}]"
HAN = r"[\x{4e00}-\x{9fff}]"
LATIN = r"[A-Za-z0-9_\x{c0}-\x{24f}]"
#: Marks that don't count when two transcriptions are compared (fixed values).
SIMILARITY_MARKS = r"，。、！？…!?~〜·「」『』,.!?：:；;（）()【】《》〈〉\[\]\"'“”‘’—－_／/"
#: The mark of a row that was left untranslated (a fixed format).
UNTRANSLATED = "[未翻译]"


def strip(c: Column) -> Column:
    """Unicode white space off both ends; texts without any there, most of them, aren't searched."""
    blank = F.substring(c, 1, 1).rlike(BLANK) | F.substring(c, -1, 1).rlike(BLANK)
    return F.when(~blank, c).otherwise(F.regexp_replace(F.regexp_replace(c, f"^{BLANK}+", ""), f"{BLANK}+$", ""))


def norm_words(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", "")


def norm_spaces(c: Column) -> Column:
    """Runs of white space to one space, ends stripped."""
    spaced = F.translate(F.coalesce(c, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def norm_similarity(c: Column) -> Column:
    """White space and the punctuation in SIMILARITY_MARKS dropped before comparing two transcriptions."""
    return F.translate(F.coalesce(c, F.lit("")), BLANKS + re.sub(r"\\(.)", r"\1", SIMILARITY_MARKS), "")


def norm_match(c: Column) -> Column:
    """NFKC, punctuation dropped, white space folded."""
    return norm_marks(nfkc(c))


def norm_marks(c: Column) -> Column:
    """norm_match() of a text in NFKC form. In ASCII, punctuation is a short list."""
    return norm_spaces(F.when(ascii_only(c), F.translate(c, "!\"#%&'()*,-./:;?@[\\]_{}~", "")).otherwise(F.regexp_replace(c, r"[\p{P}…⋯‥~〜～·]", "")))


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def compact(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), BLANKS, "")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(norm_spaces(c).cast("binary"), 256), 1, 32)


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character sets; 0 when a side is empty."""
    left, right = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    both = F.size(F.array_intersect(left, right))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(both / (F.size(left) + F.size(right) - both))


def weighted_length(c: Column) -> Column:
    """CJK characters count 1, all others one half."""
    return F.length(F.regexp_replace(c, r"[^\x{2E81}-\x{10FFFF}]", "")) * 0.5 + F.length(c) * 0.5


def cjk_dominant(c: Column) -> Column:
    return (F.length(c) > 0) & (2 * F.length(F.regexp_replace(c, r"[^\x{2E81}-\x{10FFFF}]", "")) >= F.length(c))


def is_untranslated(c: Column) -> Column:
    return F.startswith(strip(F.coalesce(c, F.lit(""))), F.lit(UNTRANSLATED))


def normalize_untranslated(c: Column, source: Column) -> Column:
    """A mark followed by a leftover translation becomes the mark and the source, or the bare mark without a source."""
    rest = strip(F.substring(strip(c), len(UNTRANSLATED) + 1, 1 << 20))
    src = strip(F.coalesce(source, F.lit("")))
    return F.when(~is_untranslated(c) | (rest == ""), c).when(src != "", F.concat(F.lit(UNTRANSLATED + " "), src)).otherwise(F.lit(UNTRANSLATED))


def strip_pause(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:…|⋯|〜|~)+\s*$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def tag_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"<[^>]+>"))


def kana_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"))


def clip(c: Column, limit: int = 60) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


def fluent(c: Column, target: str = "zh") -> Column:
    """Two Han characters; for other targets two Latin letters and no kana."""
    if target == "zh":
        return F.regexp_count(c, F.lit(HAN)) >= 2
    return (F.regexp_count(c, F.lit("[A-Za-z]")) >= 2) & ~c.rlike(KANA)


def acronym(c: Column) -> Column:
    """The first run of two or more capital Latin letters that is a word; null without one."""
    found = F.regexp_extract(c, r"(?<![\p{L}\p{N}_])([A-Z]{2,})(?![\p{L}\p{N}_])", 1)
    return F.when(found != "", found)


def grammar_hints(c: Column, before: Column) -> Column:
    """What a row's grammar suggests, as names in order: contrast, modifier, omitted_subject, plural_adnominal. before
    holds the texts of the rows in front. The patterns are fixed values."""
    contrast = c.rlike("(?<![一-鿿])(が|けど|けれども)")
    omitted = strip(c).rlike(r"[でがしよねなわ、…]$") & before.rlike("[はが]")
    plural = c.rlike("(?:僕|私|俺|ボク|ワタシ|オレ)たち[^はがを。！？]{0,12}で")
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in ((contrast, "contrast"), (c.rlike(r"\S+の\S+"), "modifier"), (omitted, "omitted_subject"), (plural, "plural_adnominal")))))


#: What a report line has of its own run (fixed formats): the time after its label, and the summary line's label.
RUN_TIME, RUN_SUMMARY = r"时间: \d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "TM: "


def report_line(c: Column) -> Column:
    """A report line without what changes from run to run: clock times and the memory's summary line."""
    timeless = F.regexp_replace(c, RUN_TIME, "时间: <归一化>")
    return F.when(F.startswith(c, F.lit(RUN_SUMMARY)), F.lit("TM: <归一化>")).otherwise(timeless)


def keep_last_part(c: Column) -> Column:
    """The text after the last ' ||| '."""
    return F.substring_index(c, " ||| ", -1)


#: Rows that stand for a deleted one, and lines in which a model comments on its work (fixed patterns).
PLACEHOLDERS = (rf"^[（(]{BLANK}*[削删]{BLANK}*除", rf"^[（(]?{BLANK}*(?:ASR|杂音|噪声|呼吸声|无实义|孤立)")
CHATTER = rf"本批次|[Ss]cene{BLANK}*\p{{Nd}}|#\p{{Nd}}|硬性豁免特征|无删除条目|全部保留|^(?:说明|总结|注[：:]|Note{BLANK}*[：:])"
#: What a reply may echo of a hint, and of a hint that was translated into English (fixed patterns).
HINT_ECHO = (r"(?s)【语法提示】.*?原文：", r"【语法提示】[^\n]*", r"(?m)^原文：[^\n]*")
HINT_ECHO_EN = (r"(?m)^\[Grammar Tip\][^\n]*", r"(?m)^- Word segmentation reference:[^\n]*", r"(?m)^Word segmentation:[^\n]*", r"(?m)^(?:Original|Source): [^\n]*", r"(?m)^\*\*Final:\*\*$", r"(?m)^English: ")


def is_placeholder(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return s.rlike(PLACEHOLDERS[0]) | s.rlike(PLACEHOLDERS[1])


def strip_chatter(c: Column) -> Column:
    """A text without the lines that comment on the work."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return strip(F.array_join(F.filter(lines, lambda x: ~x.rlike(CHATTER)), "\n"))


def strip_hint_echo(c: Column, target: str = "") -> Column:
    """A reply without echoed hints, and of 'source ||| target' the last part. For the target en the English echo goes
    too, and runs of empty lines that it leaves become one."""
    for pattern in HINT_ECHO:
        c = F.regexp_replace(c, pattern, "")
    if target == "en":
        for pattern in HINT_ECHO_EN:
            c = F.regexp_replace(c, pattern, "")
        c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(keep_last_part(c))


def strip_language_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"\.(japanese|chinese|translated)$", "")


def drop_lines(c: Column, pattern: str) -> Column:
    """Lines that match go."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def evidence_times(c: Column) -> Column:
    """Milliseconds of all H:MM:SS,mmm stamps in a text."""
    stamps = F.regexp_extract_all(c, F.lit(r"(\d+:\d{2}:\d{2}[,.]\d+)"), 1)
    part = lambda s, k: F.split(s, r"[:,.]")[k].cast("long")
    return F.transform(stamps, lambda s: ((part(s, 0) * 60 + part(s, 1)) * 60 + part(s, 2)) * 1000 + part(s, 3))


def first_json(c: Column, opening: str = "[") -> Column:
    """The widest JSON array (or object) in a fenced reply; null where it isn't JSON."""
    found = F.regexp_extract(c, r"(?s)\[.*\]" if opening == "[" else r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def peel_quotes(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"""(?s)^(".*"|'.*'|「.*」|“.*”)$""") & (F.length(s) > 1), strip(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)


def csv_pairs(c: Column, limit: int = 20) -> Column:
    """'a,b' lines as an array of (src, dst), at most limit."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^[^,，\t]+[,，\t].*\S"))
    return F.slice(F.transform(lines, lambda x: F.struct(strip(F.regexp_extract(x, r"^([^,，\t]+)", 1)).alias("src"), strip(F.regexp_extract(x, r"^[^,，\t]+[,，\t](.*)$", 1)).alias("dst"))), 1, limit)


def contains_term(term: Column, text: Column) -> Column:
    """A term occurs, not inside a longer Latin word. Both sides are folded: full-width forms and capitals count as plain ones."""
    return contains_folded(fold(term), fold(text))


def contains_folded(t: Column, s: Column) -> Column:
    """contains_term() of texts that are folded already."""
    quoted = F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))
    left = F.when(F.substring(t, 1, 1).rlike(LATIN), F.lit(f"(?<!{LATIN})")).otherwise(F.lit(""))
    right = F.when(F.substring(t, -1, 1).rlike(LATIN), F.lit(f"(?!{LATIN})")).otherwise(F.lit(""))
    short = (F.length(t) == 0) | ((F.length(t) < 2) & t.rlike(r"^[\x00-\x7f]*$"))
    return F.when(short | ~F.contains(s, t), False).otherwise(F.regexp_like(s, F.concat(left, quoted, right)))


def fold(c: Column) -> Column:
    """NFKC, lower-cased; fold a row once and keep it."""
    return F.lower(nfkc(c))


def nfkc(c: Column) -> Column:
    """NFKC; ASCII texts, which it leaves alone, don't travel to Python."""
    return F.when(ascii_only(c), c).otherwise(_nfkc(F.when(~ascii_only(c), c)))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, longest first, of two short texts; 0 where one is empty. A text inside another of fewer
    than 200 characters, where no character counts as too frequent, is one block; so is an equal one of any length."""
    def ratio(x: str, y: str) -> float:
        if x and y and (x == y or len(y) < 200 and (x in y or y in x)):
            return 2.0 * min(len(x), len(y)) / (len(x) + len(y))
        return SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """One less edits over the longer length; 0 where a text is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
