"""DuckDB SQL for the operators that SQL expresses."""

from __future__ import annotations

from cuelake.llm import chat, merkle, mixing, neighbours, rules

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda k: lpad(bin(('0x' || substr(hex, k + 1, 1))::INT), 4, '0')), '') AS bits, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{_BASE32}', (16 * (substr(bits, 5 * k + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * k + 2, 1) = '1')::INT + 4 * (substr(bits, 5 * k + 3, 1) = '1')::INT
    + 2 * (substr(bits, 5 * k + 4, 1) = '1')::INT + (substr(bits, 5 * k + 5, 1) = '1')::INT)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS win FROM i, unnest(range(1, greatest(len(w) - 11, 2))) AS u(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, l.n, array_to_string(w[k:k + l.n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM iw) AS l, unnest(range(1, len(w) - l.n + 2)) AS u(k)),
h AS (SELECT doc_id, item_id, k, dw.n FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(k, k + n)) AS u(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES = {
    "op1_mix_sources": mixing.oracle(),
    "op2_warc": WARC,
    "op4_tool_calls": chat.ORACLE,
    "op9_quality_rules": rules.ORACLE,
    "op10_decontaminate": DECONTAMINATE,
    "op11_nearest_neighbours": neighbours.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
