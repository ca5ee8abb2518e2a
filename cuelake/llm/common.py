"""Pieces the pipeline operators share: durable intermediate results, checked broadcasts and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that split on ASCII white space only.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a per-group side may be broadcast; the count is taken before each use.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session takes a new temporary
    folder (tests); on a cluster that would be the driver's own disk, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cuelake-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint; a lost executor then costs nothing that was finished."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """A durable frame on as many tasks as its counted rows ask for. Every task of an exchange leaves files of its own, so
    small frames on many tasks would cost more disk than their rows."""
    df = durable(df)
    return df.coalesce(max(1, -(-df.count() // rows_per_task)))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a durable frame when its counted rows stay within the limit; else leave the choice to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; null keys count as fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(mod)), F.lit(0).cast("long"))


def row_hash(doc_id: Column, text: Column) -> Column:
    """60-bit hash of a row's id and text. Only rows equal in both tie."""
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


#: Least and most bits of a filter that is sent to executors (8 KB to 64 MB), and how many there are per key.
FILTER_BITS, BITS_PER_KEY = (1 << 16, 1 << 29), 16
_BLOCK = 1 << 12


def filter_fits(keys: int) -> bool:
    """Whether a filter of so many keys still tells most other keys apart."""
    return keys <= FILTER_BITS[1] // 4


def bit_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A filter of a durable frame's 64-bit keys whose size follows their counted number: no key is missed, others pass at
    the rate of the bits set. It is packed on the executors; the driver gets the filter itself and nothing else."""
    size = min(max(1 << (BITS_PER_KEY * max(keys.count(), 1) - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    spot = F.col(key).bitwiseAND(F.lit(size - 1))
    spots = keys.select(F.shiftright(spot, 15).cast("int").alias("block"), spot.bitwiseAND(F.lit(8 * _BLOCK - 1)).cast("int").alias("at"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(8 * _BLOCK, np.uint8)
        bits[frame["at"].to_numpy()] = 1
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "data": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    for row in spots.groupBy("block").applyInPandas(pack, "block int, data binary").toLocalIterator():  # size / 8 bytes in all
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["data"], np.uint8)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64).view(np.uint64) & np.uint64(8 * bits.size - 1)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


# -- vectorised word hashing -------------------------------------------------------------------------

_SEGMENT = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers[0].size < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0], _powers[1]


def byte_class(pattern_bytes) -> np.ndarray:
    """256 flags: which bytes belong to words."""
    flags = np.zeros(256, bool)
    flags[list(pattern_bytes)] = True
    return flags


SPACE_WORD_BYTES = byte_class(set(range(256)) - {0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D})
ALNUM_WORD_BYTES = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _segment(b: np.ndarray, flags: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    inside = flags[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    if inside[-1]:
        edges = np.concatenate((edges, [b.size]))
    if not edges.size:
        return [np.empty(0, np.uint64)] * (1 + len(prefixes))
    power, inverse = _grown(b.size)
    sums = np.zeros(b.size + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: b.size], out=sums[1:])
    starts, ends = edges[0::2], edges[1::2]
    whole = mixed((sums[ends] - sums[starts]) * inverse[starts])
    begun = [np.where(starts + n < ends, mixed((sums[np.minimum(starts + n, ends)] - sums[starts]) * inverse[starts] + np.uint64(n)), np.uint64(0)) for n in prefixes]
    return [whole, *begun]


def word_hashes(raw: bytes, flags: np.ndarray, prefixes: tuple[int, ...] | None = None):
    """64-bit hash of every word of a UTF-8 text, in order. Long texts go through in segments cut between words.

    With prefixes, also a list of hashes of the words' beginnings of so many bytes, 0 for words not longer."""
    b = np.frombuffer(raw, np.uint8)
    parts, at = [], 0
    while at < b.size:
        end = min(at + _SEGMENT, b.size)
        while end < b.size and flags[b[end]]:
            rest = flags[b[end : end + _SEGMENT]]
            end += int(rest.size if rest.all() else np.argmin(rest))
        parts.append(_segment(b[at:end], flags, prefixes or ()))
        at = end
    joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64)] * (1 + len(prefixes or ()))
    return joined[0] if prefixes is None else (joined[0], joined[1:])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; empty when there are fewer."""
    n = words.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = acc * _BASE + words[j : j + n]
    return mixed(acc)


def as_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes or None."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
