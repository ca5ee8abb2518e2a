"""Which texts contain which needles: by the rarest gram of each needle, or inside groups of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Needles, and characters of theirs, up to which all tasks get them. Characters of texts that are looked through at a time.
FEW, CHARS, PIECE = 50_000, 1 << 24, 1 << 20
#: Longest gram. Needles of a gram that meet its texts at a time, and texts of a gram that do.
GRAM, NEEDLES, TEXTS = 3, 1000, 50_000


def _grams(c: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))


def containing(texts: DataFrame, needles: DataFrame, ids: list[str], key: str, test: Column | None = None, needles_at_once: int = NEEDLES, texts_at_once: int = TEXTS) -> DataFrame:
    """ids, key and t for every text (ids, s) that contains a needle (key, t); empty needles are in none. test, over s and t, asks
    for more than containing.

    A needle is looked up by one gram of its own, of up to three characters: the one that the fewest texts have, so common
    beginnings gather nothing. Where a gram still has many needles or many texts, both are dealt over a grid and each pair
    meets in one of its cells, so no task gets all of a gram. Only ids and grams travel; texts are fetched for
    candidates, which are verified."""
    own = F.array_distinct(F.when(F.length("t") == 1, _grams(F.col("t"), 1)).when(F.length("t") == 2, _grams(F.col("t"), 2)).otherwise(_grams(F.col("t"), GRAM)))
    needles = needles.select(key, "t").filter("t <> ''").withColumn("grams", own)
    all_ = F.array_distinct(F.flatten(F.array(*(_grams(F.col("s"), k) for k in range(1, GRAM + 1)))))
    wanted = needles.select(F.explode("grams").alias("gram")).distinct()
    held = texts.select(*ids, F.explode(all_).alias("gram")).join(wanted, "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    each = needles.select(key, "t", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(counts, "gram")
    rarest = each.groupBy(key, "t", "n").agg(F.count(F.lit(1)).alias("there"), F.min(F.struct("texts", "gram")).alias("x")).filter("there = n").select(key, "t", "x.texts", "x.gram")
    grid = rarest.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / needles_at_once).cast("int").alias("rows"), F.ceil(F.max("texts") / texts_at_once).cast("int").alias("columns"))
    deal = lambda by, n: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.join(grid, "gram").withColumn("column", deal(ids, "columns")).withColumn("row", every("rows")).select(*ids, "gram", "row", "column")
    right = rarest.join(grid, "gram").withColumn("row", deal([key], "rows")).withColumn("column", every("columns")).select(key, "t", "gram", "row", "column")
    return left.join(right, ["gram", "row", "column"]).select(*ids, key, "t").join(texts.select(*ids, "s"), ids).filter(F.contains("s", "t") if test is None else test).drop("s")


def containing_in(texts: DataFrame, needles: DataFrame, group: str, test: Callable[[Column], Column], needles_at_once: int = NEEDLES) -> DataFrame:
    """texts' columns and needles' for every text and needle of the same group (a file, say) for which test, over the needle's
    struct, holds. Needles of other groups are never met, so no gram is laid out and work grows with the groups' number.
    A group's needles go in parts of about needles_at_once, each of which meets the group's texts."""
    needle = F.struct(*(c for c in needles.columns if c != group))
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(group)) / needles_at_once)
    dealt = needles.select(group, needle.alias("_n"), F.pmod(F.xxhash64(needle), parts).alias("_part"))
    dealt = dealt.groupBy(group, "_part").agg(F.collect_list("_n").alias("_n"))
    return texts.join(dealt, group).withColumn("_n", F.explode(F.filter("_n", test))).select(*texts.columns, "_n.*")


def few(needles: DataFrame, t: str = "t") -> bool:
    """Whether all tasks may get the rows of a settled frame with texts t."""
    n, size = needles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(t)), F.lit(0))).first()
    return n <= FEW and size <= CHARS


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _packed(codes: np.ndarray, k: int) -> np.ndarray:
    """The grams of k characters, 21 bits each, as numbers; places that shorter grams don't have hold no character."""
    n = max(codes.size - k + 1, 0)
    return sum((codes[j : n + j] if j < k else np.int64((1 << 21) - 1)) << np.int64(21 * j) for j in range(GRAM)) if n else np.empty(0, np.int64)


def first_containing(texts: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """key and id: the least id of the texts (id, s) that contain a needle (key, t), for needles that are few(); empty ones are
    in none. Tasks get the needles and take texts as they come, so no gram is laid out or shuffled: of the texts at hand only
    those with a needle's rarest gram among them are looked into, and a needle that has a gram of none is passed over."""
    rows = [r for r in needles.select(key, "t").filter("t <> ''").collect()]
    keys, wanted = [r[0] for r in rows], [r[1] for r in rows]
    own = [np.unique(_packed(_codes(t), min(len(t), GRAM))) for t in wanted]
    grams = np.unique(np.concatenate([np.empty(0, np.int64), *own]))
    at = np.searchsorted(grams, np.concatenate([np.empty(0, np.int64), *own])).astype(np.int32)
    edges = np.concatenate(([0], np.cumsum([x.size for x in own], dtype=np.int64)))
    kinds = sorted({min(len(t), GRAM) for t in wanted})

    def look(ids: np.ndarray, held: list[str], best: dict[int, int]) -> None:
        order = np.argsort(ids, kind="stable")
        ids, held = ids[order], [held[k] for k in order]
        codes, sizes = _codes("\0".join(held)), np.fromiter(map(len, held), np.int64, len(held))
        row = np.repeat(np.arange(len(held)), sizes + 1)[: codes.size]
        met = []
        for k in kinds:
            packed = _packed(codes, k)
            place = np.minimum(np.searchsorted(grams, packed), grams.size - 1)
            hit = np.flatnonzero(grams[place] == packed)
            met.append(place[hit] * len(held) + row[hit])
        met = np.unique(np.concatenate(met))  # by gram, then by id
        counts = np.bincount(met // len(held), minlength=grams.size)
        ends, each = counts.cumsum(), counts[at]
        for n in np.flatnonzero(np.minimum.reduceat(each, edges[:-1])):
            g = at[edges[n] + each[edges[n] : edges[n + 1]].argmin()]
            t, least = wanted[n], best.get(n)
            for r in (met[ends[g] - counts[g] : ends[g]] % len(held)).tolist():
                if least is not None and ids[r] >= least:
                    break
                if t in held[r]:
                    best[n] = int(ids[r])
                    break

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), pa.compute.utf8_length(batch.column(1)).to_numpy()
            piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // PIECE
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                look(ids[a:b], batch.column(1).slice(a, b - a).to_pylist(), best)
        yield pa.RecordBatch.from_arrays([pa.array([keys[n] for n in best], kind), pa.array(best.values(), pa.int64())], [key, "id"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind, schema = to_arrow_type(needles.schema[key].dataType), StructType([needles.schema[key], StructField("id", LongType())])
    if not rows:
        return needles.sparkSession.createDataFrame([], schema)
    found = texts.select(F.col("id").cast("long"), "s").filter("id is not null and s is not null").mapInArrow(find, schema)
    return found.groupBy(key).agg(F.min("id").alias("id"))
