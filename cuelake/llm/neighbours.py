"""Exact nearest neighbours by a block matrix join.

Vectors are packed once. Equal vectors are one class, which keeps the smallest ids that any query can need, so a vector
that a third of all rows share is scored once. Classes are dealt by hash over stripes and queries over panels; a task
gets one cell, a stripe against a panel, whose bytes are bounded whatever the table's size. Inside a cell vectors of unit
length become int8 codes, c = round(x / s), with the length e of what is lost. The product of two tiles of codes, which is
exact, gives the cosine up to e_x + e_y + e_x e_y. Pairs whose upper bound stays below the k-th best cosine known so far
go; the others are computed in double precision from the original vectors and merged into the query's k best of the
cell. The k best of all cells of a query are merged at the end, at most k rows of each cell. No index is fitted and
nothing is sampled: recall is 1.

Edge cases: vectors that are null, empty, zero or hold null, NaN or infinite components, and those whose squared length
leaves the range of a double, take no part, as query or as neighbour; vectors of another length than the query's aren't
its neighbours; rows with a null id are no queries but can be neighbours, after all others of equal score; equal rows are
one; of different vectors with one id each is a query of its own and none is the other's neighbour; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import durable

#: Bytes and rows of a side of a cell, about; rows of either side of a tile in it.
SIDE_BYTES, SIDE_ROWS, TILE = 1 << 25, 1 << 17, 1024
#: Codes up to which a float32 product of int8 tiles is exact: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1024
#: What rounding in double precision may add to a bound.
SLACK = 1e-9


def _packing(kind: str):
    """id and vector (its bytes) of the rows that take part."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # null is NaN, -0 is 0
            keep, raw = [], []
            for i, (start, end) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
                x = values[start:end].astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    length = np.dot(x, x)
                if 0 < length < np.inf:  # false for NaN
                    keep.append(i)
                    raw.append(values[start:end].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], ["id", "raw"])

    return pack


def packed(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Distinct id, raw (floats stay floats, other numbers become doubles) and dim of the rows that take part."""
    kind = "f4" if dict(rows.dtypes)[vector] == "array<float>" else "f8"
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(vector) if kind == "f4" else F.col(vector).cast("array<double>")).alias("v"))
    out = chosen.filter("v is not null").mapInArrow(_packing(kind), "id long, raw binary").distinct()
    return out.withColumn("dim", (F.octet_length("raw") / np.dtype(kind).itemsize).cast("int"))


def _matrix(table: pa.Table) -> np.ndarray:
    raw = table["raw"].to_pylist()
    kind = np.float32 if len(raw[0]) == 4 * table["dim"][0].as_py() else np.float64
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows at unit length, their steps, and the length of what the codes lose."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    code = np.rint(x / step).astype(np.int8)
    lost = x - code * step
    return code, step[:, 0], np.sqrt((lost * lost).sum(axis=1))


def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two tiles of int8 codes. Sums of 1,024 products are whole numbers below 2 ** 24, so float32 holds them."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, added up in order of the components."""
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        na += a[:, j] * a[:, j]
        nb += b[:, j] * b[:, j]
    with np.errstate(over="ignore", divide="ignore"):
        both = na * nb
    safe = (both > 0) & (both < np.inf)
    return np.clip(dot / np.where(safe, np.sqrt(np.where(safe, both, 1)), np.sqrt(na) * np.sqrt(nb)), -1, 1)


def _ordered(query: np.ndarray, score: np.ndarray, none: np.ndarray, vec: np.ndarray) -> np.ndarray:
    return np.lexsort((vec, none, -score, query))


def _best(k: int, found: list[np.ndarray]) -> list[np.ndarray]:
    """The k best of each query, in order, of (query, score, without id, id)."""
    order = _ordered(*found)
    found = [x[order] for x in found]
    starts = np.flatnonzero(np.concatenate(([True], found[0][1:] != found[0][:-1]))) if order.size else np.empty(0, int)
    rank = np.arange(order.size) - np.repeat(starts, np.diff(np.concatenate((starts, [order.size]))))
    return [x[rank < k] for x in found]


def _cell(k: int, size: int):
    """The k best neighbours that a stripe holds for each query of a panel."""
    def search(stripe: pa.Table, panel: pa.Table) -> pa.Table:
        if not (stripe.num_rows and panel.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "raw": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        theirs, own, mine = _matrix(stripe), _matrix(panel), panel["id"].to_numpy()
        ids = [[(x is None, x or 0) for x in group] for group in stripe["ids"].to_pylist()]
        tiles = [codes(theirs[at : at + size].astype(np.float64)) for at in range(0, len(theirs), size)]
        out = []
        for first in range(0, len(own), size):
            best = _scan(own[first : first + size].astype(np.float64), mine[first : first + size], theirs, tiles, ids, k)
            out.append([best[0] + first, *best[1:]])
        query, score, none, vec = (np.concatenate(x) for x in zip(*out, strict=True))
        take = pa.array(query)
        return pa.table({"query_id": panel["id"].take(take), "raw": panel["raw"].take(take), "vec_id": pa.array(vec, pa.int64(), mask=none), "score": pa.array(score)})

    return search


def _scan(own: np.ndarray, mine: np.ndarray, theirs: np.ndarray, tiles: list, ids: list, k: int) -> list[np.ndarray]:
    """The k best of a few queries against all tiles of a stripe, one tile after the other."""
    best = [np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0, np.int64)]
    a, step_a, lost_a = codes(own)
    limit = np.full(len(own), -np.inf)  # the k-th best cosine so far
    at = 0
    for b, step_b, lost_b in tiles:
        near = tile(a, b) * step_a[:, None] * step_b
        doubt = lost_a[:, None] + lost_b + lost_a[:, None] * lost_b + SLACK
        if near.shape[1] > k:  # k classes besides the query's own are at least so near
            limit = np.maximum(limit, np.partition(near - doubt, near.shape[1] - k - 1, axis=1)[:, near.shape[1] - k - 1])
        q, c = np.nonzero(near + doubt >= limit[:, None])
        for part in range(0, q.size, 1 << 16):
            pq, pc = q[part : part + (1 << 16)], at + c[part : part + (1 << 16)]
            members = [ids[i] for i in pc]
            times = np.array([len(m) for m in members])
            pairs = np.array([x for m in members for x in m], np.int64).reshape(-1, 2)
            new = [np.repeat(pq, times), np.repeat(cosines(own[pq], theirs[pc].astype(np.float64)), times), pairs[:, 0].astype(bool), pairs[:, 1]]
            other = new[2] | (new[3] != mine[new[0]])
            best = _best(k, [np.concatenate((x, y[other])) for x, y in zip(best, new, strict=True)])
        full, last = np.bincount(best[0], minlength=len(own)) == k, np.full(len(own), np.inf)
        np.minimum.at(last, best[0], best[1])
        limit = np.where(full, np.maximum(limit, last), limit)
        at += len(b)
    return best


def nearest(rows: DataFrame, k: int = 5, queries: Column | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest by cosine of every row that queries picks (ids divisible by 50)."""
    points = packed(rows, id_col, vector)
    picked = points.filter(F.col("id") % 50 == 0 if queries is None else queries).filter("id is not null")
    # k + 1 ids are enough: a query leaves out its own. Spark cuts a class to them before it is shuffled.
    place = F.row_number().over(Window.partitionBy("raw").orderBy(F.col("id").asc_nulls_last()))
    members = points.withColumn("place", place).filter(F.col("place") <= k + 1)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])  # k + 1 at most
    classes = durable(members.groupBy("raw").agg(listed.alias("ids"), F.first("dim").alias("dim")))
    asked = durable(picked)
    width = lambda df: [x or 0 for x in df.agg(F.sum(F.octet_length("raw")), F.count(F.lit(1))).first()]
    sides = lambda held, n: max(-(-held // SIDE_BYTES), -(-n // SIDE_ROWS), 1)
    held, n = width(classes)
    # As many stripes as their bytes ask for, and as the session's parallelism where there are rows for it.
    stripes = max(sides(held, n), min(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 256)))
    panels = sides(*width(asked))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = classes.withColumn("stripe", F.pmod(F.xxhash64("raw"), F.lit(stripes)).cast("int")).withColumn("panel", every(panels))
    right = asked.withColumn("panel", F.pmod(F.xxhash64("id", "raw"), F.lit(panels)).cast("int")).withColumn("stripe", every(stripes))
    cell = ["dim", "stripe", "panel"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k, TILE), "query_id long, raw binary, vec_id long, score double")
    order = Window.partitionBy("query_id", "raw").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same sums in the same order; list_cosine_similarity adds up in order of the components.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
