"""Near-duplicate documents by SetSketch registers.

A document is the set of its 5-word shingles. Register j holds the exponentially spaced, truncated minimum
floor(1 - log_b x) of -log(1 - u) over its shingles' hashes under the j-th mixing, so registers of two sets agree
about as often as their Jaccard similarity, and the sketch of a union is the register-wise maximum. Four registers
make a band; 32 bands miss a pair at similarity 0.75 once in 200,000.

Documents with equal sets are one class. Classes that share a band are compared: all with each other in small
buckets, in large ones each with the bucket's most central member. Candidates whose likelihood-estimated similarity
is far too low go; the rest are verified on full sets. The members of large buckets that still hold several components
are then joined exactly on their sets: shingles are ordered by rarity, and two sets of the threshold's similarity share
one of the rarest seventh of the smaller and the rarest quarter of the larger. These prefixes are joined across
components, less what sizes and places rule out, in blocks where a shingle is frequent. So a bucket's size ends no
search, and members of one component are never paired again.

Edge cases: no words, or a null text, is the empty set: linked with nothing, its component is its own id; fewer
words than five are one shingle; null ids are kept and take no part as the smallest id unless all are null; equal
rows are one class; different texts may share an id; an empty table gives an empty result; other columns of the input
are ignored. deduplicated() keeps one row of each component, however many rows share its smallest id or text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import SPACE_WORD_BYTES, as_bytes, bit_filter, durable, filter_fits, gathered, in_filter, mixed, shingle_hashes, small, word_hashes
from cuelake.llm.components import components

REGISTERS, BAND = 128, 4
BASE = 1.001
WORDS = 5
#: Size up to which all members of a bucket are compared with each other at once.
CHUNK = 12
#: Places of the table of shingle frequencies, and rows of a frequent shingle that are joined at a time.
RANKS, BLOCK = 1 << 22, 1024
#: Estimated similarity below which a candidate isn't verified: 0.75 less six standard errors of 128 registers.
DOUBT = 0.52

_rng = np.random.default_rng(7)
_A = (_rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]


def shingle_set(raw: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text, A-Z lower-cased."""
    if not raw:
        return np.empty(0, np.uint64)
    words = word_hashes(raw.lower(), SPACE_WORD_BYTES)
    if not words.size:
        return words
    return np.unique(shingle_hashes(words, min(WORDS, words.size)))


def registers(items: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes, as 16-bit registers."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, short.size, 512):
        np.minimum(low, (short[None, at : at + 512] * _A + _B).min(axis=1), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    acc = np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64)
    for part in regs.reshape(-1, BAND).T:
        acc = mixed(acc + part.astype(np.uint64))
    return acc.view(np.int64)


def joint_similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 24) -> np.ndarray:
    """Likelihood estimate of the Jaccard similarity of pairs from their registers (a row per pair) and set sizes."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) > likelihood(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _sketching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, regs, hashes = [], [], [], []
        for raw in as_bytes(batch.column(1)):
            items = shingle_set(raw)
            keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if items.size else None)
            sizes.append(items.size)
            own = registers(items) if items.size else None
            regs.append(None if own is None else own.tobytes())
            hashes.append(None if own is None else bands(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "key", "n", "regs", "bands", "_text"])


def _shingling(wanted: np.ndarray | None):
    """key and set of the documents whose id passes the filter."""
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(in_filter(wanted, batch.column(0).to_numpy())))
            sets = [shingle_set(raw) for raw in as_bytes(batch.column(1))]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["key", "items"])

    return shingle


def _placing(shared: np.ndarray):
    """key and band of the bands that pass the filter."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            bands_ = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            inside = in_filter(shared, bands_)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[inside])), pa.array(bands_[inside])], ["key", "band"])

    return place


def sketches(docs: DataFrame, extra: Column | None = None) -> DataFrame:
    """doc_id, key (digest of the set, null when empty), n, regs, bands and _text (the extra column) for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(None) if extra is None else extra).cast("string").alias("_text"))
    return rows.mapInArrow(_sketching, "doc_id long, key binary, n long, regs binary, bands array<long>, _text string")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose sizes and registers don't rule out the threshold."""
    side = lambda name: classes.select(F.col("key").alias(name), F.col("n").alias(f"n{name}"), F.col("regs").alias(f"r{name}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter("100 * least(na, nb) >= 75 * greatest(na, nb)")

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                ra, rb = (np.frombuffer(b"".join(f[c]), np.uint16).reshape(len(f), -1) for c in ("ra", "rb"))
                f = f[joint_similarity(ra, rb, f.na.to_numpy(float), f.nb.to_numpy(float)) >= DOUBT]
            yield f[["a", "b", "na", "nb"]]

    return rows.mapInPandas(keep, "a binary, b binary, na long, nb long")


def _sets(docs: DataFrame, keys: DataFrame, owners: DataFrame) -> DataFrame:
    """key, items: the full shingle sets of the classes in keys, read from the text of one document each. Texts are
    picked by a filter of ids where it is selective, else by a join; the set's own key decides."""
    needed = gathered(keys.join(owners, "key").withColumn("h", F.xxhash64("doc_id")))
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("text").cast("string").alias("text"))
    fits = filter_fits(needed.count())
    texts = texts if fits else texts.join(needed.select("h"), "h", "left_semi")
    found = texts.mapInArrow(_shingling(bit_filter(needed, "h") if fits else None), "key binary, items array<long>")
    return gathered(found.join(small(needed.select("key")), "key", "left_semi").dropDuplicates(["key"]), 2_000)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets reach the threshold."""
    rows = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("key").alias("b"), F.col("items").alias("ib")), "b")
    both = F.size(F.array_intersect("ia", "ib"))
    return rows.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    out = _components(docs, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components(docs: DataFrame, percent: int, extra: Column | None = None) -> DataFrame:
    """doc_id, key, n_shingles, component_id and label, the class that names the component (null without shingles)."""
    rows = durable(sketches(docs, extra))
    full = rows.filter("key is not null")
    classes = gathered(full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")))
    owners = classes.select("key", "doc_id")
    placed = classes.select("key", F.explode("bands").alias("band"))
    buckets = gathered(placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    # Bands of one member are left out by a filter before rows are dealt; members of large buckets are never dealt by
    # band: the few large bands and their leads go to them.
    if filter_fits(buckets.count()):
        placed = classes.select("key", "bands").mapInArrow(_placing(bit_filter(buckets, "band")), "key binary, band long")
    crowded = small(buckets.filter(F.col("size") > CHUNK))
    large = gathered(placed.join(crowded, "band"))
    whole = placed.join(crowded.select("band"), "band", "left_anti").join(buckets.select("band"), "band").groupBy("band").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # CHUNK keys at most
    near = whole.select(F.posexplode("keys").alias("i", "a"), "keys").select("a", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("b"))
    # The lead of a large bucket is its most central member: the one whose buckets hold the most.
    weight = gathered(large.groupBy("key").agg(F.sum("size").alias("weight")))
    lead = gathered(large.join(small(weight), "key").groupBy("band").agg(F.max(F.struct("weight", "key"))["key"].alias("lead")))
    star = large.join(small(lead), "band").filter("key <> lead").select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b"))
    pairs = gathered(_likely(star.union(near).distinct(), classes))
    links = gathered(_verified(pairs, _sets(docs, _ends(pairs), owners), percent))
    labels = components(links)
    more = _closed(labels, large, pairs, classes, docs, owners, percent)
    if more is not None:
        labels = components(links.union(more))
    sets = classes.select("key", "doc_id").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    lowest = gathered(sets.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    named = gathered(sets.join(lowest, "label").select("key", "label", "component_id"))
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles"), "_text").join(named, "key", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _closed(labels: DataFrame, large: DataFrame, pairs: DataFrame, classes: DataFrame, docs: DataFrame, owners: DataFrame, percent: int) -> DataFrame | None:
    """The links that are left in large buckets of several components; None when there is no such bucket.

    Shingles of one set alone come first in the order and need no row; they only use up places of the prefix."""
    large = large.select("band", "key").join(small(labels.withColumnRenamed("node", "key")), "key", "left").withColumn("label", F.coalesce("label", "key"))
    split = gathered(large.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band"))
    open_ = gathered(large.join(small(split), "band", "left_semi").select("key", "label").distinct())
    if not open_.head(1):
        return None
    sets = _sets(docs, open_.select("key"), owners)
    twice = sets.mapInArrow(_item_counts, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).filter("n > 1")
    ranks = _ranks(twice)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, items, places, sizes = [], [], [], []
            for i, values in enumerate(batch.column(1).to_pylist()):
                x = np.asarray(values, np.int64)
                rank = ranks[x.view(np.uint64) & np.uint64(RANKS - 1)]
                order = np.lexsort((x, rank))[: x.size - -(-percent * x.size // 100) + 1]
                at = np.flatnonzero(rank[order] > 0)
                own.append(np.full(at.size, i))
                items.append(x[order[at]])
                places.append(at)
                sizes.append(np.full(at.size, x.size))
            take = pa.array(np.concatenate([np.empty(0, np.int64), *own]).astype(np.int64))
            whole = lambda parts: pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), whole(items), whole(places), whole(sizes)], ["key", "item", "place", "n"])

    rows = gathered(sets.mapInArrow(prefixes, "key binary, item long, place long, n long").join(open_, "key"))
    counts = rows.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("item").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("top"))
    counts = gathered(counts.filter("labels > 1").select("item", "top", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    rows = durable(rows.join(small(counts), "item").withColumn("out", F.col("label") != F.col("top")))
    # The smaller set gives its first places only: twice the threshold over one and the threshold of it may be missing.
    first = rows.filter(F.col("place") <= F.col("n") - F.ceil(2 * percent * F.col("n") / F.lit(100 + percent))).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    second = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    side = lambda df, x: df.select("item", "block", *(F.col(c).alias(f"{c}{x}") for c in ("key", "label", "n", "place")))
    possible = F.expr(f"labela <> labelb and struct(na, keya) < struct(nb, keyb) and 100 * na >= {percent} * nb and {100 + percent} * least(na - placea, nb - placeb) >= {percent} * (na + nb)")
    meet = lambda a, b: side(a, "a").join(side(b, "b"), ["item", "block"]).filter(possible)
    # Two members of a shingle's most frequent component needn't meet.
    met = meet(first.filter("out"), second).unionByName(meet(first.filter("not out"), second.filter("out")))
    cross = met.select(F.least("keya", "keyb").alias("a"), F.greatest("keya", "keyb").alias("b")).distinct()
    more = gathered(_likely(cross.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), classes))
    return gathered(_verified(more, sets, percent))


def _ranks(twice: DataFrame) -> np.ndarray:
    """For each place of a table of hashed shingles, four times the logarithm of how often they occur; 0 for once."""
    place = F.col("item").bitwiseAND(F.lit(RANKS - 1)).cast("int")
    counts = twice.select(F.shiftright(place, 12).alias("block"), place.bitwiseAND(F.lit(4095)).alias("at"), "n")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(frame["at"].to_numpy(), frame["n"].to_numpy(), 4096)
        block = np.where(n > 0, np.minimum(np.floor(np.log2(np.maximum(n, 1)) * 4), 255), 0).astype(np.uint8)
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "data": [block.tobytes()]})

    out = np.zeros(RANKS, np.uint8)
    for row in counts.groupBy("block").applyInPandas(pack, "block int, data binary").toLocalIterator():  # RANKS bytes in all
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["data"], np.uint8)
    return out


def _item_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, n = np.unique(np.concatenate([np.empty(0, np.int64), *(np.asarray(x, np.int64) for x in batch.column(1).to_pylist())]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(n.astype(np.int64))], ["item", "n"])


def _sifting(gone: np.ndarray, doubtful: bool):
    """Rows whose hash, the last column, is in a filter (doubtful) or isn't, without that column."""
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # what goes back is small, however long the texts are
                part = batch.slice(at, 256)
                inside = in_filter(gone, part.column(part.num_columns - 1).to_numpy())
                yield part.filter(pa.array(inside == doubtful)).select(list(range(part.num_columns - 1)))

    return sift


def deduplicated(docs: DataFrame) -> DataFrame:
    """The input with one row of each component: of the rows with its smallest id, the one with the smallest text digest.
    Rows without shingles are components of their own; of rows with equal id and text one stays.

    Rows that a filter of the removed ones rules out stay where they are; only the others, removed ones nearly all, are
    joined with the rows to keep. So the texts of what stays aren't shuffled."""
    text = lambda df: F.coalesce(F.md5(df["text"].cast("string").cast("binary")), F.lit(""))
    rows = _components(docs, 75, text(docs))
    group = F.coalesce(F.col("label"), F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "_text")).cast("binary"))
    kept = rows.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")).alias("k"))
    kept = gathered(kept.select(F.col("k.doc_id").alias("_id"), F.col("k._text").alias("_text")))
    again = gathered(rows.groupBy("doc_id", "_text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"), "_text"))
    is_row = lambda df, side: df["doc_id"].cast("long").eqNullSafe(side["_id"]) & (text(df) == side["_text"])
    both = rows.select("doc_id", F.col("_text").alias("_digest"))
    gone = gathered(both.join(kept, both["doc_id"].eqNullSafe(kept["_id"]) & (both["_digest"] == kept["_text"]), "left_anti").select(F.xxhash64("doc_id", "_digest").alias("h")))
    if filter_fits(gone.count()):
        bits = bit_filter(gone, "h")
        hashed = docs.select("*", F.xxhash64(docs["doc_id"].cast("long"), text(docs)).alias("_row_hash_"))
        doubtful = hashed.mapInArrow(_sifting(bits, True), docs.schema)
        out = hashed.mapInArrow(_sifting(bits, False), docs.schema).unionByName(doubtful.join(kept, is_row(doubtful, kept), "left_semi"))
    else:
        out = docs.join(kept, is_row(docs, kept), "left_semi")
    if not again.head(1):
        return out
    again = small(again)
    repeated = out.join(again, is_row(out, again), "left_semi")
    one = repeated.withColumn("_row", F.struct(*docs.columns)).groupBy(repeated["doc_id"].cast("long"), text(repeated)).agg(F.first("_row").alias("_row")).select("_row.*")
    return out.join(again, is_row(out, again), "left_anti").unionByName(one)
