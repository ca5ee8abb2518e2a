"""Quality rules: repetition inside a document and lines that a host repeats across documents. DataFrame functions only.

Lines are normalised (lower case, white space folded, digits to 0) and hashed; per host the distinct documents that
hold a line are counted. A line in more than most of them is boilerplate and removed, however large the host is; a
document that loses too much of itself is rejected. So exact copies of a text, when there are more of them, take all
its lines from each: near-duplicate removal belongs before this. by="texts" counts distinct texts instead, where it can't.

Edge cases: a document is its doc_id, rows without one are documents each; a null or empty text has no words and fails the base rule; a null source is a host of its own; rows
with equal source and text share a verdict; an empty table gives an empty result; columns of the input named as
the operator's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import durable, small

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5


def words_of(text: Column) -> Column:
    """Words as an array; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more. The hashes are sorted with their places only where some repeat."""
    def windows(ws: Column) -> Column:
        starts = F.slice(ws, 1, F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2), F.get(ws, i + 3), F.get(ws, i + 4)))

    def cover(hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = _let(placed, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])), lambda x: x["i"])))
        return _let(same, lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b))

    return _let(words, lambda ws: _let(windows(ws), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(cover(hs))))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _line_norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]", "0"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, _host, _text (hash of the text), _doc (the id, or a name of the row), the base columns and _lines, an array of (h, n): a line's hash and its words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("_host"), text.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id", "_host", F.xxhash64("_t").alias("_text"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).alias("_doc"),
        _let(words_of(F.col("_t")), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _repeated(ws).cast("long").alias("r"))).alias("_w"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"), F.transform(ls, lambda x: F.struct(F.xxhash64(_line_norm(x)).alias("h"), F.size(words_of(x)).alias("n"))).alias("each"))).alias("_l"),
    ).select("doc_id", "_host", "_text", "_doc", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"), F.col("_l.each").alias("_lines"))


def quality_rules(docs: DataFrame, most: int = 20, min_left: float = 0.5, min_words: int = 10, max_repeat: int = 20, by: str = "documents") -> DataFrame:
    """doc_id, the base columns, base_failed, n_removed_words (words in boilerplate lines), n_left_words and kept."""
    unit = {"documents": "_doc", "texts": "_text"}[by]
    rows = durable(measured(docs))
    each = rows.select("_host", "_text", "_doc", F.explode("_lines").alias("x")).select("_host", "_text", "_doc", "x.h", "x.n")
    copies = durable(rows.groupBy("_host", "_text").agg(F.count(F.lit(1)).alias("copies")))
    counts = each.select("_host", "h", unit).distinct().groupBy("_host", "h").agg(F.count(F.lit(1)).alias("held"))
    common = durable(counts.filter(F.col("held") > most).select("_host", "h"))
    lost = each.join(small(common), ["_host", "h"]).groupBy("_host", "_text").agg(F.sum("n").alias("all"))
    # Rows with equal source and text have the same lines: the sum over them is shared among them.
    lost = durable(lost.join(copies, ["_host", "_text"]).select("_host", "_text", (F.col("all") / F.col("copies")).cast("long").alias("lost")))
    out = rows.drop("_lines", "_doc").join(small(lost), ["_host", "_text"], "left")
    lost_words = F.coalesce("lost", F.lit(0))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - lost_words
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        lost_words.alias("n_removed_words"), left.alias("n_left_words"), (~base & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, t, i, ws[i:i+4] AS win FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i)),
r AS (SELECT doc_id, t, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, t, win) > 1),
s AS (SELECT doc_id, t, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, t ORDER BY i) AS nxt FROM r) GROUP BY doc_id, t),
l AS (SELECT doc_id, host, t, unnest(ls) AS ln FROM w),
m AS (SELECT doc_id, host, t, trim(regexp_replace(regexp_replace(lower(ln), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS k, len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) AS n FROM l),
c AS (SELECT host, k FROM m GROUP BY host, k HAVING count(DISTINCT doc_id) > 20),
x AS (SELECT doc_id, t, sum(n)::BIGINT AS lost FROM m JOIN c USING (host, k) GROUP BY doc_id, t),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(s.n, 0) AS n_repeat_words, coalesce(lost, 0) AS n_removed_words
      FROM w LEFT JOIN s ON w.doc_id = s.doc_id AND w.t = s.t LEFT JOIN x ON w.doc_id = x.doc_id AND w.t = x.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_removed_words, n_words - n_removed_words AS n_left_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM b
"""
