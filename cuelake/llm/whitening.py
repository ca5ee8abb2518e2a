"""Whitening of embeddings by exact linear algebra.

Entries become whole numbers x = floor(64 * c) + 1,000,000. Of the distinct vectors, n in all, tasks add up sums and
products in integers; these meet a matrix row at a time, so nothing that grows with the table reaches one task or the
driver. The scatter n * sum(x x') - S S' is n ** 2 times the covariance, without any rounding. Its characteristic
polynomial is found modulo as many primes as the size of its coefficients asks for, each in a task of its own by reduction
to Hessenberg form, and put together by Chinese remainders. All its roots are real, so the number of roots above a
point is the number of sign changes of the polynomial moved there; that isolates the largest roots, multiple ones too,
by bisection, and simple ones are then narrowed on the sign alone until the interval is 2 ** -96 of the root. A component
is the null vector of scatter - root, by inverse iteration in fixed-point integers of at least 256 bits, a task per
distinct root; vectors of a multiple root are made orthogonal.

Edge cases: rows whose vector is null or holds null, NaN or infinite entries are dropped, as are vectors with an entry
whose x doesn't fit a 64-bit integer and vectors of another length than the most frequent one (the longer of two), which have
no common space; null ids are kept and repeated rows are rows each, but count once in the fit; components of eigenvalue 0
have whitened null and explained 0 (null where all are 0) and identity_error is over the others (null if there is none); a
deviation that exceeds a long is null, deviation_exact holds it whole in any case; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import gcd, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import durable

STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Width of a root's interval and least precision of the elimination, in bits.
ROOT_BITS, SOLVE_BITS = 96, 256


# -- integers from vectors --------------------------------------------------------------------------

def _numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part and their x - SHIFT, from lists of doubles of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    steps = np.floor(values * STEPS)
    good = (np.abs(steps) < 2.0**62).all(axis=1)  # false for NaN
    return np.flatnonzero(good), steps[good].astype(np.int64)


def _rounding(dim: int):
    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _numbers(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "x"])

    return numbers


def rounded(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id and x (bytes of 64-bit integers, less SHIFT) of the rows that take part, and their common length."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    dim = lengths.agg(F.max(F.struct("rows", "dim"))["dim"]).first()[0] or 0
    return rows.filter(F.size("v") == dim).mapInArrow(_rounding(dim), "vec_id long, x binary"), dim


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, dim)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x in whole numbers: by float64 while sums stay below 2 ** 53, by Python's integers where entries are too large."""
    top = int(np.abs(x).max(initial=0))
    if top * top * 1024 >= 1 << 53:
        return x.astype(object).T @ x.astype(object)
    out = np.zeros((x.shape[1], x.shape[1]), np.int64).astype(object)
    at = max(1024, min(len(x), ((1 << 53) - 1) // max(top * top, 1)))
    for first in range(0, len(x), at):
        part = x[first : first + at].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and scatter n * sum(x x') - S S' of a frame of integer vectors x, exactly. dim rows of dim numbers reach the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), dim)
            n, products = n + len(x), products + _products(x)
            sums = sums + (x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([[str(n), *map(str, sums)], *([str(v) for v in row] for row in products)])], ["row", "values"])

    def total(table: pa.Table) -> pa.Table:
        return pa.table({"row": table["row"][:1], "values": pa.array([[str(sum(map(int, column))) for column in zip(*table["values"].to_pylist(), strict=True)]])})

    shape = "row int, values array<string>"
    found = {r["row"]: [int(v) for v in r["values"]] for r in fit.select("x").mapInArrow(add, shape).groupBy("row").applyInArrow(total, shape).collect()}
    if not found:
        return 0, [0] * dim, [[0] * dim for _ in range(dim)]
    n, sums = found[-1][0], found[-1][1:]
    return n, sums, [[n * found[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]


# -- characteristic polynomial ----------------------------------------------------------------------

def primes(count: int) -> list[int]:
    """The largest primes below 2 ** 31."""
    small = [p for p in range(2, isqrt(1 << 31) + 1) if all(p % q for q in range(2, isqrt(p) + 1))]
    out, top = [], 1 << 31
    while len(out) < count:
        flags, low = np.ones(1 << 16, bool), top - (1 << 16)
        for p in small:
            flags[-low % p :: p] = False
        out += [low + int(k) for k in np.flatnonzero(flags)[::-1]]
        top = low
    return out[:count]


def characteristic_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - m) modulo p, from the constant term up."""
    h, d = np.array(m, np.int64) % p, len(m)
    for k in range(d - 2):  # similar to m at each step, zeros below the subdiagonal at the end
        found = np.flatnonzero(h[k + 1 :, k])
        if not found.size:
            continue
        i = k + 1 + int(found[0])
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        times = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - times[:, None] * h[k + 1] % p) % p
        for j, t in enumerate(times.tolist()):
            if t:
                h[:, k + 1] = (h[:, k + 1] + h[:, k + 2 + j] * t) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        nxt = np.zeros(d + 1, np.int64)
        nxt[1:] = polys[k, :-1]
        nxt = (nxt - h[k, k] * polys[k]) % p
        run = 1
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            nxt = (nxt - int(h[i, k]) * run % p * polys[i]) % p
        polys[k + 1] = nxt
    return [int(v) for v in polys[d]]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(t - m) of a symmetric positive semidefinite matrix, from the constant term up. The driver gets
    one list of residues for each prime."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # Each coefficient is a symmetric function of roots whose mean is trace / d: at most (1 + trace / d) ** d.
    bits = d * ((trace // d + 2).bit_length() + 1) + 2
    wanted = primes(bits // 30 + 1)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f["p"].tolist():
                yield pd.DataFrame({"p": [p], "residues": [characteristic_mod(np.array([[v % p for v in row] for row in m], np.int64), p)]})

    found = spark.createDataFrame([(p,) for p in wanted], "p long").repartition(min(len(wanted), 256)).mapInPandas(reduce, "p long, residues array<long>").collect()
    whole, out = 1, [0] * (d + 1)
    for p, residues in sorted(map(tuple, found)):
        inverse = pow(whole, -1, p)
        out = [c + whole * ((r - c) * inverse % p) for c, r in zip(out, residues, strict=True)]
        whole *= p
    return [c - whole if 2 * c > whole else c for c in out]


# -- roots -------------------------------------------------------------------------------------------

def _shifted(poly: list[int], at: int, bits: int) -> list[int]:
    """Coefficients of 2 ** (bits * d) * poly((t + at) / 2 ** bits)."""
    d = len(poly) - 1
    out = [c << (bits * (d - k)) for k, c in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            out[j] += at * out[j + 1]
    return out


def above(poly: list[int], at: int, bits: int = 0) -> int:
    """Roots over at / 2 ** bits, with multiplicity, of a polynomial with real roots only (Descartes' rule is exact then)."""
    signs = [c > 0 for c in _shifted(poly, at, bits) if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], at: int, bits: int) -> int:
    value = 0
    for k, c in enumerate(reversed(poly)):
        value = value * at + (c << (bits * k))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[Fraction, int]]:
    """The positive roots among the count largest, as (root, multiplicity), falling; the last may reach beyond count.
    A root's interval is narrower than 2 ** -ROOT_BITS of it; roots that close are one."""
    zeros = next(k for k, c in enumerate(poly) if c)  # roots that are 0
    poly, out = poly[zeros:], []
    top = 1 << max((-(-(abs(c).bit_length()) // (len(poly) - 1 - k)) for k, c in enumerate(poly[:-1]) if c), default=0) + 1  # Fujiwara's bound
    # (low, high, bits, roots over low, roots over high) in steps of 2 ** -bits
    open_ = [(0, top, 0, len(poly) - 1, 0)]
    while open_ and sum(m for _, m in out) < count:
        low, high, bits, more, less = open_.pop()
        if more == less:
            continue
        if low and (more - less == 1 or high - low <= low >> ROOT_BITS):
            if more - less == 1:
                low, high, bits = _narrowed(poly, low, high, bits)
            out.append((Fraction(low + high, 2 << bits), more - less))
            continue
        if high - low < 2:
            low, high, bits = low << 32, high << 32, bits + 32
        mid = (low + high) >> 1
        between = above(poly, mid, bits)
        open_ += [(low, mid, bits, more, between), (mid, high, bits, between, less)]  # the upper half is next
    return out


def _narrowed(poly: list[int], low: int, high: int, bits: int) -> tuple[int, int, int]:
    """A simple root's interval (low, high], halved on the sign of the polynomial. The sign just over low is the one at
    low, or the other one than at high where low is itself a root."""
    end = _sign(poly, high, bits)
    while end and high - low > low >> ROOT_BITS:
        if high - low < 2 or not low >> ROOT_BITS:
            low, high, bits = low << 32, high << 32, bits + 32
        mid = (low + high) >> 1
        here = _sign(poly, mid, bits)
        if here == 0:
            return mid, mid, bits
        low, high = (low, mid) if here == end else (mid, high)
    return (high, high, bits) if end == 0 else (low, high, bits)


# -- components --------------------------------------------------------------------------------------

def null_vectors(m: list[list[int]], root: Fraction, count: int) -> list[list[float]]:
    """count orthonormal vectors that m - root takes nearest to 0, by inverse iteration in fixed-point integers."""
    d, size = len(m), max(abs(v) for row in m for v in row).bit_length()
    bits = SOLVE_BITS + 2 * ROOT_BITS + size
    one = 1 << bits
    a = np.array([[v << bits for v in row] for row in m], object)
    # a root that is exact would stop the elimination; this is far below what a double shows
    moved = (root.numerator << bits) // root.denominator + (1 << max(bits + size - 2 * ROOT_BITS, 0))
    for i in range(d):
        a[i, i] -= moved
    order, steps = np.arange(d), []
    for k in range(d):
        i = k + max(range(d - k), key=lambda j: abs(a[k + j, k]))
        a[[i, k]], order[[i, k]] = a[[k, i]], order[[k, i]]
        pivot = a[k, k] or 1
        times = np.array([(v << bits) // pivot for v in a[k + 1 :, k]], object)
        a[k + 1 :, k + 1 :] -= (times[:, None] * a[k, k + 1 :]) >> bits
        a[k + 1 :, k] = times
    start = np.random.default_rng(13).integers(-(1 << 20), 1 << 20, (count, d))
    found: list[list[int]] = []
    for row in start.tolist():
        v = [x << (bits - 20) for x in row]
        for _ in range(3):
            v = [v[i] for i in order]
            for k in range(d):
                v[k] -= sum(int(a[k, j]) * v[j] for j in range(k)) >> bits
            for k in range(d - 1, -1, -1):
                v[k] = ((v[k] << bits) - (sum(int(a[k, j]) * v[j] for j in range(k + 1, d)))) // int(a[k, k] or 1)
            top = max(map(abs, v)) or 1
            v = [(x << bits) // top for x in v]
            for other in found:
                along = sum(x * y for x, y in zip(v, other, strict=True)) >> bits
                v = [x - (along * y >> bits) for x, y in zip(v, other, strict=True)]
            length = isqrt(sum(x * x for x in v)) or 1
            v = [(x << bits) // length for x in v]
        found.append(v)
    out = []
    for v in found:
        lead = max(v, key=abs)
        out.append([float(Fraction(-x if lead < 0 else x, one)) for x in v])
    return out


def components(spark: SparkSession, scatter: list[list[int]], count: int = COMPONENTS) -> list[tuple[float, list[float]]]:
    """(root of the scatter, unit vector) of the positive roots among the count largest, falling."""
    divisor = gcd(*(v for row in scatter for v in row)) or 1
    m = [[v // divisor for v in row] for row in scatter]
    roots = largest_roots(characteristic(spark, m), count) if any(map(any, m)) else []
    tasks, left = [], count
    for k, (root, times) in enumerate(roots):
        tasks.append((k, str(root), min(times, left)))
        left -= times

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, root, times in f.itertuples(index=False):
                yield pd.DataFrame({"k": [k] * times, "vector": null_vectors(m, Fraction(root), times)})

    if not tasks:
        return []
    found = spark.createDataFrame(tasks, "k int, root string, times int").repartition(len(tasks), "k").mapInPandas(solve, "k int, vector array<double>").collect()
    return [(float(roots[r["k"]][0] * divisor), list(r["vector"])) for r in sorted(found, key=lambda r: r["k"])]


# -- whitening ---------------------------------------------------------------------------------------

def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in 64-bit integers where they fit, else in Python's."""
    top = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    if top < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def whitened_error(fit: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of the fit's whitened vectors, less the identity: a mean, then centred products."""
    k = len(weights)
    if not k:
        return None

    def added(mean: np.ndarray | None):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if mean is None else (k, k))
            for batch in batches:
                w = (_centred(_matrix(batch.column(0).to_pylist(), weights.shape[1]), n, sums) / n).astype(np.float64) @ weights.T
                total += w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

        rows = fit.select("x").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k * k at most
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["at"])]) / n

    mean = added(None)
    return float(np.abs(added(mean).reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and deviation_exact (decimal text) for every
    remaining row and component."""
    spark = vectors.sparkSession
    rows, dim = rounded(vectors, id_col, vector)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    if not dim:
        return spark.createDataFrame([], shape)
    fit = durable(rows.select("x").distinct())
    n, sums, scatter = moments(fit, dim)
    found = components(spark, scatter, count)
    trace = sum(scatter[i][i] for i in range(dim))
    shown = min(count, dim)
    explained = [root / trace for root, _ in found] + [0.0 if trace else None] * (shown - len(found))
    weights = np.array([np.array(v) * (n / np.sqrt(root)) for root, v in found]).reshape(-1, dim)  # eigenvalue: root / n ** 2
    error = whitened_error(fit, n, sums, weights)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            centred = _centred(_matrix(batch.column(1).to_pylist(), dim), n, sums)
            if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * dim < 1 << 63:
                exact = (centred * centred).sum(axis=1).tolist()
            else:
                exact = (centred.astype(object) ** 2).sum(axis=1).tolist()
            w = np.full((m, shown), np.nan)
            w[:, : len(weights)] = (centred / n).astype(np.float64) @ weights.T
            ids, each = pa.array(np.repeat(np.arange(m), shown)), np.tile(np.arange(shown), m)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(ids), pa.array(each + 1, pa.int32()), pa.array(np.full(m * shown, n)), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(ids), pa.array(w.ravel(), mask=each >= len(weights)),
                pa.array(explained, pa.float64()).take(pa.array(each)), pa.array([error] * (m * shown), pa.float64()), pa.array([str(v) for v in exact]).take(ids),
            ], [c.split()[0] for c in shape.split(", ")])

    return rows.mapInArrow(project, shape)
