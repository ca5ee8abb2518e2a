"""Merkle manifest of documents as a persistent tree.

A leaf is the SHA-256 of a document's fields, each as its UTF-8 length and value, or "-" where null. The leaves of a
language, in order of doc_id, are hashed in pairs up to a subroot, the subroots in order of language up to the root; a
node without a partner is hashed alone. Places in a language come from one range sort: counts per sorted partition give
each partition's offset. The tree is cut into aligned blocks of 1,024 nodes. A task holds one block and its subtree; its
root is a leaf of the blocks above, so a language of n leaves takes log_1024(n) rounds, and what lies above a block is
found once per block, from the top down, not once per leaf.

The tree is persistent: changing a leaf makes a version that shares every untouched node with the tree and copies the
leaf's ancestors only, first those in the leaf's own block, then, in the same task, those on the block's way to the
root, whatever the number of versions. versions() returns the copies, manifest() holds every version against the root.

Edge cases: nulls are "-" in the leaf; a null lang is a language of its own, before all others; null ids come first in
their language and their leaves are never changed by the report; leaves of equal id are ordered by digest, so repeated
rows are leaves each and reruns agree; texts are hashed whole; one leaf is its own subroot, one subroot the root, the
proof of a lone leaf is the hash of nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import durable, small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block holds the subtree of 2 ** BITS nodes.
BITS = 10

Edit = Callable[[DataFrame], dict[str, Column]]


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(_encoded(fields[c]) for c in FIELDS)).cast("binary"), 256))


def tampering(docs: DataFrame) -> dict[str, Column]:
    """The report's change: n_chars plus 1 where 7 divides the crc32 of the id; elsewhere no change."""
    hit = F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 7 == 0
    return {"when": hit, "n_chars": docs["n_chars"].cast("decimal(20,0)") + 1}


def leaves(docs: DataFrame, edit: Edit = tampering) -> DataFrame:
    """g (key of the language), lang, doc_id, digest and forged (the changed leaf, null where nothing changes)."""
    fields = {c: docs[c].cast("long") if c == "doc_id" else docs[c] for c in FIELDS}
    change = edit(docs)
    forged = F.when(change.pop("when"), _leaf(fields | change))
    return docs.select(_encoded(docs["lang"]).alias("g"), docs["lang"].cast("string").alias("lang"), fields["doc_id"].alias("doc_id"), _leaf(fields).alias("digest"), forged.alias("forged"))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at, their place in their group g by order, from 0, and n, the rows of the group. order starts with what
    makes groups contiguous. A partition number and a row number inside it order everything; only counts per partition
    and group are added up."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    laid = durable(rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row"))
    laid = laid.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    runs = laid.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = durable(runs.select("g", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n")))
    return laid.join(small(runs), ["g", "_part"]).withColumn("at", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _hash(nodes: bytes) -> bytes:
    """H of nodes, which are hashed as hexadecimal text."""
    return hashlib.sha256(nodes.hex().encode()).digest()


def _subtree(nodes: list[bytes], height: int) -> list[list[bytes]]:
    levels = [nodes]
    for _ in range(height):
        nodes = [_hash(b"".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def _height(n: int, bits: int, base: int = 0) -> int:
    """Levels of a block whose nodes lie base levels over the n leaves of their tree."""
    return min(bits, (n - 1).bit_length() - base)


def _siblings(levels: list[list[bytes]], at: int) -> list[bytes | None]:
    """The partner of the node and of each of its ancestors below the subtree's root; None where there is none."""
    return [level[(at >> k) ^ 1] if (at >> k) ^ 1 < len(level) else None for k, level in enumerate(levels[:-1])]


def _copied(leaf: bytes, at: int, siblings: list[bytes | None]) -> list[bytes]:
    """The ancestors of a leaf, from below: the nodes that a version with this leaf doesn't share."""
    path = []
    for k, other in enumerate(siblings):
        leaf = _hash(leaf if other is None else other + leaf if at >> k & 1 else leaf + other)
        path.append(leaf)
    return path


def _blocks(rows: DataFrame, items: list[str]) -> DataFrame:
    """g, block, n, at (first place), digests, the items as arrays, and root, for every block of ranked rows."""
    kinds, bits = dict(rows.dtypes), BITS

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        digests, at, n = table["digest"].to_pylist(), table["at"][0].as_py(), table["n"][0].as_py()
        out = {"g": [table["g"][0].as_py()], "block": [at >> bits], "n": [n], "digests": [digests], "root": [_subtree(digests, _height(n, bits))[-1][0]]}
        return pa.table(out | {c: pa.array([table[c].to_pylist()], pa.list_(table[c].type)) for c in items})

    shape = "g string, block long, n long, digests array<binary>, root binary" + "".join(f", {c} array<{kinds[c]}>" for c in items)
    return durable(rows.groupBy("g", F.shiftright("at", BITS).alias("block")).applyInArrow(pack, shape))


def _climbing(base: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    def climb(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        levels = _subtree(table["digest"].to_pylist(), _height(table["n"][0].as_py(), bits, base))
        paths = [_siblings(levels, k) for k in range(table.num_rows)]
        return pa.table({"g": table["g"], "i": table["i"], "n": table["n"], "path": pa.array(paths, pa.list_(pa.binary())), "top": [levels[-1][0]] * table.num_rows})

    return climb


def _above(blocks: DataFrame) -> DataFrame:
    """g, block, path (partners on the block's way up, null where there is none) and top (root of the group's tree)."""
    nodes, rounds, base = blocks.select("g", F.col("block").alias("i"), "n", F.col("root").alias("digest")), [], BITS
    while (open_ := nodes.filter(F.col("n") > F.lit(1 << base))).head(1):
        rounds.append(durable(open_.groupBy("g", F.shiftright("i", BITS).alias("up")).applyInArrow(_climbing(base, BITS), "g string, i long, n long, path array<binary>, top binary")))
        nodes = rounds[-1].filter(F.col("i") % (1 << BITS) == 0).select("g", F.shiftright("i", BITS).alias("i"), "n", F.col("top").alias("digest"))
        base += BITS
    nothing = F.array().cast("array<binary>")
    found = None
    for level in reversed(rounds):
        level = level.drop("n")
        if found is not None:
            over = found.select("g", F.col("i").alias("up"), F.col("path").alias("more"), F.col("top").alias("last"))
            level = level.withColumn("up", F.shiftright("i", BITS)).join(over, ["g", "up"], "left").select("g", "i", F.concat("path", F.coalesce("more", nothing)).alias("path"), F.coalesce("last", "top").alias("top"))
        found = level
    if found is None:
        return blocks.select("g", "block", nothing.alias("path"), F.col("root").alias("top"))
    found = found.withColumnsRenamed({"i": "block"})
    return blocks.select("g", "block", "root").join(found, ["g", "block"], "left").select("g", "block", F.coalesce("path", nothing).alias("path"), F.coalesce("top", "root").alias("top"))


def _languages(tops: DataFrame) -> DataFrame:
    """g, langs_at, langs_path and root: each language's place among the subroots, its partners up to the root, the root."""
    rows = tops.select(F.lit("").alias("g"), F.col("g").alias("item"), "lang", F.col("top").alias("digest"))
    blocks, bits = _blocks(_ranked(rows, ["lang"]), ["item"]), BITS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = _subtree(r["digests"], _height(r["n"], bits))
                paths = [_siblings(levels, k) + r["path"] for k in range(len(r["digests"]))]
                places = [(r["block"] << bits) + k for k in range(len(paths))]
                yield pa.RecordBatch.from_arrays([pa.array(r["item"], pa.string()), pa.array(places, pa.int64()), pa.array(paths, pa.list_(pa.binary())), pa.array([r["top"]] * len(paths), pa.binary())], ["g", "langs_at", "langs_path", "root"])

    return durable(blocks.join(_above(blocks), ["g", "block"]).mapInArrow(spread, "g string, langs_at long, langs_path array<binary>, root binary"))


def _trees(docs: DataFrame, edit: Edit) -> DataFrame:
    """A row for every block of leaves, with all that lies between it and the root."""
    rows = _ranked(leaves(docs, edit), ["lang", "doc_id", "digest"])
    blocks = _blocks(rows, ["doc_id", "forged"])
    above = durable(_above(blocks))
    lang = F.when(F.col("g") != "-", F.expr("substring(g, instr(g, ':') + 1)"))
    tops = above.filter("block = 0").select("g", lang.alias("lang"), "top")
    return blocks.drop("root").join(above, ["g", "block"]).join(small(_languages(tops)), "g").withColumn("lang", lang)


def _rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[dict, int, list[bytes | None], list[bytes]]]:
    """For every leaf: its block's row, its place in the block, its partners up to the root and the nodes its version copies."""
    for batch in batches:
        for k in range(batch.num_rows):  # a block at a time
            r = batch.slice(k, 1).to_pylist()[0]
            levels = _subtree(r["digests"], _height(r["n"], bits))
            for j, (leaf, forged) in enumerate(zip(r["digests"], r["forged"], strict=True)):
                at = (r["block"] << bits) + j
                lower = _siblings(levels, j) + r["path"]
                path = _copied(forged or leaf, at, lower)
                path += _copied(path[-1] if path else forged or leaf, r["langs_at"], r["langs_path"])
                yield r, j, lower + r["langs_path"], path


def manifest(docs: DataFrame, edit: Edit = tampering) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every document, and what its version folds to."""
    bits = BITS

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for r, j, partners, path in _rows(batches, bits):
            leaf = r["digests"][j]
            folded = path[-1] if path else r["forged"][j] or leaf
            proof = _hash(b"".join(x for x in partners if x is not None))
            out.append((r["doc_id"][j], leaf.hex(), r["top"].hex(), r["root"].hex(), proof.hex(), folded.hex(), folded == r["root"]))
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _trees(docs, edit).mapInArrow(report, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def versions(docs: DataFrame, edit: Edit = tampering) -> DataFrame:
    """The nodes that versions don't share with the tree: for every changed leaf (lang, doc_id) one row per level, with
    tree (leaf levels count up from 0 to the subroot, then those over the subroots), place and digest."""
    bits = BITS

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "doc_id", "tree", "level", "place", "digest"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        out: list[tuple] = []
        for r, j, _, path in _rows(batches, bits):
            if r["forged"][j] is not None:
                at, below = (r["block"] << bits) + j, len(path) - len(r["langs_path"])
                for k, node in enumerate([r["forged"][j], *path]):
                    own = k <= below
                    out.append((r["lang"], r["doc_id"][j], "leaves" if own else "subroots", k if own else k - below, at >> k if own else r["langs_at"] >> (k - below), node.hex()))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _trees(docs, edit).mapInArrow(copies, "lang string, doc_id long, tree string, level int, place long, digest string")


#: crc32 of a text of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT)"""
#: All nodes of the trees whose leaves base lists, level by level; m is the number of nodes of a level.
_TREE = """{name}(g, lv, i, d, m) AS (
  SELECT g, 0, pos, {leaf}, n FROM {base}
  UNION ALL
  SELECT g, any_value(lv) + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(m) + 1) // 2 FROM {name} WHERE m > 1 GROUP BY g, i // 2)"""
#: Each row's way up through a tree, from its own or its changed leaf, with the partners met.
_FOLD = """{name}(k, g, lv, i, d, m, proof) AS (
  SELECT k, g, 0, pos, d, n, proof FROM {base}
  UNION ALL
  SELECT f.k, f.g, f.lv + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 1 THEN s.d || f.d ELSE f.d || coalesce(s.d, '') END), (f.m + 1) // 2, f.proof || coalesce(s.d, '')
  FROM {name} AS f LEFT JOIN {tree} AS s ON s.g = f.g AND s.lv = f.lv AND s.i = xor(f.i, 1::BIGINT) WHERE f.m > 1)"""

ORACLE = f"""
WITH RECURSIVE e AS (
  SELECT doc_id, lang, n_chars, {_CRC.format(text="doc_id::VARCHAR")} % 7 = 0 AS hit,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS b FROM documents),
l AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
    CASE WHEN hit THEN sha256(a || coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') || b) END AS forged FROM e),
p AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
{_TREE.format(name="t", base="p", leaf="leaf")},
q AS (SELECT '' AS g, g AS lang, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE m = 1),
{_TREE.format(name="u", base="q", leaf="subroot")},
p0 AS (SELECT k, g, pos, coalesce(forged, leaf) AS d, n, '' AS proof FROM p),
{_FOLD.format(name="f", base="p0", tree="t")},
q0 AS (SELECT f.k, '' AS g, q.pos, f.d, q.n, f.proof FROM f JOIN q ON q.lang = f.g WHERE f.m = 1),
{_FOLD.format(name="h", base="q0", tree="u")}
SELECT p.doc_id, p.leaf, q.subroot, r.d AS root, sha256(h.proof) AS proof_sha256, h.d AS folded_root, h.d = r.d AS verified
FROM h JOIN p USING (k) JOIN q ON q.lang = p.g, (SELECT d FROM u WHERE m = 1) AS r WHERE h.m = 1
"""
