"""Nearest neighbours, Merkle manifest and whitening against plain versions, with odd rows."""

import hashlib
import math
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.llm import merkle, neighbours, whitening
from cuelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# -- neighbours ---------------------------------------------------------------------------------------

def vectors(spark, kind="float"):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=6)]) for k in range(220)]
    rows += [(300 + k, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for k in range(80)]  # one vector many times
    rows += [(500 + k, [2.0 + k / 1e6, 4.0, 6.0, 0.0, 0.0, 0.0]) for k in range(60)]  # many that nearly agree
    rows += [(600, None), (650, []), (700, [0.0] * 6), (750, [NAN] + [1.0] * 5), (800, [INF] + [1.0] * 5), (850, [None] + [1.0] * 5), (900, [1.0, 2.0]), (901, [2.0, 1.0]), (950, [-0.0, 2.0, 0.0, 0.0, 0.0, 1.0])]
    rows += [(None, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]), (None, None), (50, rows[50][1]), (50, rows[50][1]), (100, rows[3][1])]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return frame.withColumns({c: F.lit("clash") for c in ("id", "raw", "dim", "ids", "place", "stripe", "panel", "score", "rank", "query_id", "x", "component", "n", "v")})


def brute_neighbours(rows, k):
    points = {}
    for r in rows:
        v = r["embedding"]
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            points[(r["vec_id"], tuple(x + 0.0 for x in v))] = None
    out = []
    for q, a in points:
        if q is not None and q % 50 == 0:
            found = []
            for c, b in points:
                if c != q and len(a) == len(b):
                    dot = na = nb = 0.0
                    for x, y in zip(a, b, strict=True):
                        dot, na, nb = dot + x * y, na + x * x, nb + y * y
                    found.append((-min(1.0, max(-1.0, dot / math.sqrt(na * nb))), c is None, c or 0, c))
            out += [(q, rank, c, -s) for rank, (s, _, _, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("tile", [7, 1024])
def test_neighbours_are_exact(spark, monkeypatch, kind, tile):
    frame = vectors(spark, kind)
    monkeypatch.setattr(neighbours, "TILE", tile)
    found = [tuple(r) for r in neighbours.nearest(frame).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(found, key=str) == brute_neighbours(frame.collect(), 5)
    assert {q for q, *_ in found} >= {0, 50, 100, 300, 350, 500, 550, 900, 950} and not {q for q, *_ in found} & {600, 650, 700, 750, 800, 850}


def test_neighbours_over_many_cells(spark, monkeypatch):
    frame = vectors(spark)
    monkeypatch.setattr(neighbours, "SIDE_ROWS", 40)
    everything = neighbours.nearest(frame, k=3, queries=F.col("id") >= 0)
    assert everything.select("query_id").distinct().count() > 300
    some = [tuple(r) for r in everything.filter("query_id % 50 = 0").select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(some, key=str) == brute_neighbours(frame.collect(), 3)


def test_codes_bound_the_cosine():
    r = np.random.default_rng(1)
    for dim in (1, 3, 64, 2500):
        a, b = r.normal(size=(30, dim)) * 10.0 ** r.integers(-30, 30, (30, 1)), r.standard_cauchy(size=(40, dim))
        (ca, sa, ea), (cb, sb, eb) = neighbours.codes(a), neighbours.codes(b)
        assert ca.dtype == np.int8 and (neighbours.tile(ca, cb) == ca.astype(int) @ cb.astype(int).T).all()
        true = np.array([[neighbours.cosines(x[None], y[None])[0] for y in b] for x in a])
        assert (np.abs(true - neighbours.tile(ca, cb) * sa[:, None] * sb) <= ea[:, None] + eb + ea[:, None] * eb + neighbours.SLACK).all()


def test_neighbours_of_empty_and_few(spark):
    shape = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], shape)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, None), (50, [])], shape)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0])], shape)).count() == 0
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0]), (3, [-1.0]), (2, [2.0])], shape)).orderBy("rank").collect()
    assert [tuple(r) for r in few] == [(0, 1, 2, 1.0), (0, 2, 3, -1.0)]
    huge = neighbours.nearest(spark.createDataFrame([(0, [1e153, 1e153]), (1, [1e153, 0.0]), (2, [1e200, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert [r["vec_id"] for r in huge] == [1] and huge[0]["score"] == pytest.approx(math.sqrt(0.5))


# -- Merkle manifest ----------------------------------------------------------------------------------

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def folded(levels, at, node):
    proof = ""
    for level in levels[:-1]:
        other = level[at ^ 1] if at ^ 1 < len(level) else ""
        proof, node, at = proof + other, h(other + node if at & 1 else node + other), at >> 1
    return proof, node


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = lambda n, r=r: h("".join(map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))
        n = r["n_chars"]
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(n), leaf(n + 1 if hit and n is not None else n), r["doc_id"]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: up([x[2] for x in sorted(groups[g])]) for g in langs}
    top = up([trees[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for k, (_, _, leaf, forged, doc_id) in enumerate(sorted(groups[g])):
            low, node = folded(trees[g], k, forged)
            high, node = folded(top, at, node)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(low + high), node, node == top[-1][0]))
    return sorted(out, key=str), trees, top


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def documents(spark):
    rows = [(k, f"text {k} é", ["en", "de", None, "", "ü", "zh"][0 if k < 70 else k % 6], None if k % 5 == 0 else f"s{k % 3}", None if k % 11 == 0 else k) for k in range(150)]
    rows += [(None, "no id", "en", "s", 1), (None, None, None, None, None), (7, "x" * 300_000, "en", "s", 2), *[(9, "again", "de", "s", 3)] * 3, (-14, "below", "de", "s", 2**31 - 1), (200, "only one", "xx", None, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).withColumns({c: F.lit("clash") for c in ("g", "at", "n", "digest", "forged", "path", "top", "root", "block", "leaf", "_row", "when")})


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_is_the_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    docs = documents(spark)
    found = sorted((tuple(r) for r in merkle.manifest(docs).select(*MANIFEST).collect()), key=str)
    assert found == plain_manifest(docs.collect())[0] and 0 < sum(not r[-1] for r in found) < len(found)


def test_versions_share_all_but_the_path(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 2)
    docs = documents(spark).filter("doc_id <> 9")
    rows = docs.collect()
    plain, trees, top = plain_manifest(rows)
    want = {r[0]: r[5] for r in plain if not r[-1]}
    got = defaultdict(dict)
    for r in merkle.versions(docs).collect():
        got[r["doc_id"]][r["tree"], r["level"], r["place"], r["lang"]] = r["digest"]
    assert set(want) <= set(got)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for doc_id, root in want.items():
        (lang,) = {k[3] for k in got[doc_id]}
        height = len(trees[lang]) - 1
        assert len(got[doc_id]) == 1 + height + len(top) - 1
        # Reading the version: its own nodes where it has them, the tree's elsewhere, give its root.
        node = lambda tree, level, place: got[doc_id].get((tree, level, place, lang)) or (trees[lang] if tree == "leaves" else top)[level][place]  # noqa: B023, E731
        for tree, levels in (("leaves", trees[lang]), ("subroots", top)):
            for level in range(len(levels) - 1):
                for place in range(len(levels[level + 1])):
                    below = [node(tree, level, p) if tree == "leaves" or level or p != langs.index(lang) else node("leaves", height, 0) for p in (2 * place, 2 * place + 1) if p < len(levels[level])]
                    assert node(tree, level + 1, place) == h("".join(below))
        assert (got[doc_id].get(("subroots", len(top) - 1, 0, lang)) or node("leaves", height, 0)) == root


def test_manifest_of_small_tables(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.manifest(spark.createDataFrame([], shape)).count() == 0
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], shape)
    (r,) = merkle.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == h("") and r["verified"]
    edit = lambda d: {"when": d["doc_id"] == 1, "text": F.lit("b")}
    (r,) = merkle.manifest(one, edit).collect()
    assert not r["verified"] and r["folded_root"] == h("".join(map(field, (1, "s", "en", 1, "b"))))
    assert merkle.versions(one, edit).count() == 1
    last = spark.createDataFrame([(14, "a", "en", "s", 2**63 - 1)], shape).withColumn("doc_id", F.lit(7).cast("long"))
    assert merkle.manifest(last, lambda d: merkle.tampering(d) | {"when": F.lit(True)}).collect()[0]["verified"] is False


# -- whitening ----------------------------------------------------------------------------------------

def check_whitening(out, ids, e, fit, count=16):
    x, u = (np.floor(64 * v).astype(np.int64) + 1_000_000 for v in (e, fit))
    u = np.unique(u, axis=0)
    n, c = len(u), u - u.mean(0)
    v = c.T @ c / n
    val, vec = np.linalg.eigh(v)
    val, vec = val[::-1][:count], vec[:, ::-1][:, :count]
    first = out.drop_duplicates(["vec_id", "component"])
    assert (out["n"] == n).all() and out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    assert np.abs(first.groupby("component")["explained"].first().to_numpy() / (val / np.trace(v)) - 1).max() < 1e-9
    w = first.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    ref = (x - u.mean(0)) @ vec / np.sqrt(val)
    assert np.abs(w - ref * np.sign((w * ref).sum(0))).max() < 1e-8
    exact = ((n * x.astype(object) - u.astype(object).sum(0)) ** 2).sum(1)
    assert first[first["component"] == 1].set_index("vec_id")["deviation"].loc[ids].tolist() == [int(t) for t in exact]
    assert (out["deviation_exact"].astype(object).map(int) == out["deviation"]).all()


def test_whitening_of_the_query(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    out = QUERIES["op13_whitening"](spark, SF).toPandas()
    assert len(out) == 16 * len(rows)
    e = np.stack(rows["embedding"]).astype(float)
    check_whitening(out, rows["vec_id"], e, e)


def test_whitening_of_odd_rows(spark):
    frame = vectors(spark).unionByName(spark.createDataFrame([(990, [1e30] + [0.0] * 5)], "vec_id long, embedding array<float>"), allowMissingColumns=True)
    out = whitening.whiten(frame).toPandas()
    rows = [r for r in frame.collect() if r["embedding"] and len(r["embedding"]) == 6 and all(x is not None and math.isfinite(x) and abs(x) < 1e18 for x in r["embedding"])]
    assert len(out) == 6 * len(rows) and out["vec_id"].isna().sum() == 6  # the row of no id, repeated rows and the zero vector stay
    named = {r["vec_id"]: r["embedding"] for r in rows if r["vec_id"] not in (None, 100)}
    check_whitening(out[out["vec_id"].notna() & (out["vec_id"] != 100)], list(named), np.array(list(named.values())), np.array([r["embedding"] for r in rows]), 6)


def test_whitening_of_degenerate_tables(spark):
    shape = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [NAN])], shape)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 2, shape)).toPandas()
    assert len(one) == 4 and (one["n"] == 1).all() and (one["deviation"] == 0).all() and one["whitened"].isna().all() and one["explained"].isna().all() and one["identity_error"].isna().all()
    # Two equal eigenvalues, one of 0: 3 components with rows, orthonormal in the plane.
    corners = [(k, [float(x), float(y), 1.0]) for k, (x, y) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    out = whitening.whiten(spark.createDataFrame(corners, shape)).toPandas()
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(w[:, :2].T @ w[:, :2] / 4, np.eye(2), atol=1e-12) and np.isnan(w[:, 2]).all()
    assert out.groupby("component")["explained"].first().tolist() == [0.5, 0.5, 0.0] and out["identity_error"].iloc[0] < 1e-12
    wide = whitening.whiten(spark.createDataFrame([(k, [1e13 * k, 1.0 * k * k]) for k in range(4)], "vec_id long, embedding array<double>")).toPandas()
    assert wide["deviation"].isna().any() and wide["identity_error"].iloc[0] < 1e-6
    x = [[math.floor(64e13 * k), 64 * k * k] for k in range(4)]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert wide[wide["component"] == 1].sort_values("vec_id")["deviation_exact"].tolist() == [str(sum((4 * v - t) ** 2 for v, t in zip(r, s, strict=True))) for r in x]


def test_characteristic_polynomial_and_roots(spark):
    r = np.random.default_rng(2)
    for d in (1, 2, 3, 7):
        x = r.integers(-9, 9, (12, d))
        m = [[int(v) for v in row] for row in x.T @ x]
        if d == 7:
            m = [[m[i][j] if max(i, j) < 5 else 0 for j in range(7)] for i in range(7)]  # zero rows break the subdiagonal
        poly = whitening.characteristic(spark, m)
        minors = [1]  # coefficients from traces of powers
        power, sums = np.eye(d, dtype=int).astype(object), []
        for k in range(1, d + 1):
            power = power @ np.array(m, object)
            sums.append(int(np.trace(power)))
            minors.append(sum((-1) ** (i - 1) * minors[k - i] * sums[i - 1] for i in range(1, k + 1)) // k)
        assert poly == [(-1) ** k * minors[k] for k in range(d, -1, -1)]
        for bound in (0, 5, 200, 10**6):
            assert whitening.above(poly, bound) == (np.linalg.eigvalsh(np.array(m, float)) > bound + 1e-9).sum()
    # (t - 3)^2 (t - 1/7)(t - 10^9): multiple, tiny beside huge
    poly = [Fraction(1)]
    for root in (3, 3, Fraction(1, 7), 10**9):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    found = whitening.largest_roots([int(7 * c) for c in poly], 16)
    assert [m for _, m in found] == [1, 2, 1]
    for (root, _), want in zip(found, (10**9, 3, Fraction(1, 7)), strict=True):
        assert abs(root / want - 1) < Fraction(1, 1 << 90)
