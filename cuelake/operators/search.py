"""Full-text search over a written inverted index that grows by appended segments.

The index is a folder: forward (a row per document with its tokens), postings (a row per term and block of documents,
with the largest frequency and the shortest length in it), terms (document frequencies, as changes per segment), gone
(documents that a later segment replaced) and the manifest that commits segments. Postings and terms are partitioned
by segment and by a hash of the term, so a search reads the files of asked terms in committed segments only. Documents
are dealt to blocks of about 4,096, the same for all terms: a term that every document holds is many rows of bounded
size, and a conjunction meets block by block.

A search starts with each query's rarest term: only blocks that hold it are looked up for the others, first by their sizes and
bounds alone. The best blocks by bound give a score to beat; of the rest only those whose bound reaches it are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans import versions as V

BUCKETS, BLOCK_DOCS = 64, 4096
#: Blocks of a query that are read before the others are held against a score.
FIRST_BLOCKS = 4
#: Constants of BM25 (fixed values), and the room that rounding to nine digits needs.
K1, B, ROOM = 1.2, 0.75, 1e-8


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(T.nfkc_casefold(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, root: str, name: str, segments: list[str], schema: str) -> DataFrame:
    """One table of the index, of committed segments."""
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}").filter(F.col("seg").isin(segments))


FORWARD = "id long, digest long, tokens array<string>, len int, seg string"
POSTINGS = "term string, block int, docs array<struct<id:long,tf:int,len:int>>, n int, max_tf int, min_len int, seg string, bucket int"
TERMS = "term string, df long, seg string, bucket int"
GONE = "id long, old string, seg string"


def create(spark: SparkSession, root: str) -> None:
    """An index without documents."""
    V.commit(spark, root, 0, "index", "", docs=0, held=0, length=0, replaced=0)


def _live(spark: SparkSession, root: str, segments: list[str]) -> DataFrame:
    """The forward rows that no later segment replaced."""
    gone = _table(spark, root, "gone", segments, GONE).select("id", F.col("old").alias("seg"))
    return _table(spark, root, "forward", segments, FORWARD).join(gone, ["id", "seg"], "left_anti")


def append(rows: DataFrame, root: str, block_docs: int = BLOCK_DOCS) -> int:
    """Index rows (id, text; ids are unique) as a new segment, and return its version. Rows that the index holds with the
    same text are left out, rows whose text changed replace the old ones; nothing that was written is rewritten."""
    new = rows.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("digest"), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    return _segment(new, root, block_docs)


def _segment(new: DataFrame, root: str, block_docs: int) -> int:
    spark = new.sparkSession
    past = V.history(spark, root)
    version, segments = past[-1]["version"] + 1, [r["folder"] for r in past if r["folder"]]
    seg = V.new_name("s", version)
    if segments:
        new = new.join(_live(spark, root, segments).select("id", "digest"), ["id", "digest"], "left_anti")
    new.withColumn("len", F.size("tokens")).write.parquet(f"{root}/forward/seg={seg}")
    fresh = _table(spark, root, "forward", [seg], FORWARD)
    count = lambda df: df.agg(F.count(F.lit(1)), F.count_if(F.col("len") > 0), F.coalesce(F.sum("len"), F.lit(0))).first()
    added, less, replaced = count(fresh), (0, 0, 0), None
    if segments:
        replaced = V.settled(_live(spark, root, segments).join(fresh.select("id"), "id", "left_semi"))
        less = count(replaced)
    old = fresh.limit(0) if replaced is None else replaced
    old.select("id", F.col("seg").alias("old")).write.parquet(f"{root}/gone/seg={seg}")
    blocks = max(1, -(-added[0] // block_docs))
    words = fresh.select("id", "len", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode("tokens").alias("term")).repartition("block", "term")
    once = words.groupBy("block", "term", "id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))  # dealt by block and term, as what follows
    held = F.sort_array(F.collect_list(F.struct("id", "tf", "len")))  # about block_docs at most
    posts = once.groupBy("block", "term").agg(held.alias("docs"), F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
    posts = posts.withColumn("bucket", _bucket(F.col("term"))).repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block")
    posts.write.partitionBy("bucket").parquet(f"{root}/postings/seg={seg}")
    df = _table(spark, root, "postings", [seg], POSTINGS).select("term", "n")
    if replaced is not None:
        df = df.unionByName(replaced.select(F.explode(F.array_distinct("tokens")).alias("term"), F.lit(-1).alias("n")))
    df = df.groupBy("term").agg(F.sum("n").alias("df")).withColumn("bucket", _bucket(F.col("term")))
    df.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/terms/seg={seg}")
    V.commit(spark, root, version, "segment", seg, docs=added[0] - less[0], held=added[1] - less[1], length=added[2] - less[2], replaced=less[0])
    return version


def compact(spark: SparkSession, root: str, into: str, block_docs: int = BLOCK_DOCS) -> None:
    """The live documents as one segment of a new index under into; readers of the old one aren't disturbed."""
    segments = [r["folder"] for r in V.history(spark, root) if r["folder"]]
    create(spark, into)
    _segment(_live(spark, root, segments).select("id", "digest", "tokens"), into, block_docs)


def search(queries: DataFrame, root: str, limit: int = 20, version: int | None = None) -> DataFrame:
    """query_id, id, score and rank: for each query (query_id, text) the documents that hold all its terms, best BM25 first,
    ties to the smaller id; limit is held between 1 and 200. Queries without a term find nothing."""
    spark, k = queries.sparkSession, max(1, min(limit, 200))
    past = V.history(spark, root, version)
    segments = [r["folder"] for r in past if r["folder"]]
    docs, held, length = (sum(V.facts(r)[name] for r in past) for name in ("docs", "held", "length"))
    asked = V.settled(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("bucket", _bucket(F.col("term"))))
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    read = lambda name, schema: _table(spark, root, name, segments, schema).filter(F.col("bucket").isin(buckets))
    df = read("terms", TERMS).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    every = Window.partitionBy("query_id")
    terms = asked.drop("bucket").withColumn("n_terms", F.count(F.lit(1)).over(every)).join(df, "term").withColumn("there", F.count(F.lit(1)).over(every)).filter("there = n_terms")
    terms = terms.withColumns({"place": F.row_number().over(every.orderBy("df", "term")), "idf": F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))})
    terms = V.settled(terms.select("query_id", "term", "n_terms", "place", "idf"))
    part = lambda tf, size: F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / F.lit(length / max(held, 1))))
    spot = ["term", "seg", "block"]
    # Blocks that may hold all terms, by the rarest term's, with what a document in them can score at most.
    sizes = read("postings", POSTINGS).select(*spot, "max_tf", "min_len")
    lead = terms.filter("place = 1").join(sizes, "term").select("query_id", "seg", "block", "n_terms", part("max_tf", "min_len").alias("most"))
    others = lead.select("query_id", "seg", "block", "n_terms").join(terms.filter("place > 1").select("query_id", "term", "idf"), "query_id").join(sizes, spot)
    blocks = lead.unionByName(others.select("query_id", "seg", "block", "n_terms", part("max_tf", "min_len").alias("most"))).groupBy("query_id", "seg", "block", "n_terms").agg(F.count(F.lit(1)).alias("n"), F.sum("most").alias("most"))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "seg", "block")
    blocks = V.settled(blocks.filter("n = n_terms").select("query_id", "seg", "block", "most", F.row_number().over(order).alias("turn")))
    gone = _table(spark, root, "gone", segments, GONE).select("id", F.col("old").alias("seg")) if any(V.facts(r)["replaced"] for r in past) else None

    def scored(picked: DataFrame) -> DataFrame:
        """query_id, id and score of the documents in picked blocks that hold all terms."""
        wanted = picked.join(terms, "query_id")
        posts = read("postings", POSTINGS).select(*spot, "docs").join(wanted.select(*spot).distinct(), spot, "left_semi")
        each = posts.select(*spot, F.inline("docs"))
        found = wanted.filter("place = 1").select("query_id", *spot, "n_terms", "idf").join(each, spot)
        if gone is not None:
            found = found.join(gone, ["id", "seg"], "left_anti")
        one = found.select("query_id", "seg", "id", "n_terms", part("tf", "len").alias("part"))
        rest = one.select("query_id", "seg", "id", "n_terms").join(terms.filter("place > 1").select("query_id", "term", "idf"), "query_id").join(each, ["term", "seg", "id"])
        both = one.unionByName(rest.select("query_id", "seg", "id", "n_terms", part("tf", "len").alias("part")))
        return both.groupBy("query_id", "id", "n_terms").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("score")).filter("n = n_terms").select("query_id", "id", "score")

    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    hits = V.settled(top(scored(blocks.filter(F.col("turn") <= FIRST_BLOCKS))))
    beat = hits.filter(F.col("rank") == k).select("query_id", F.col("score").alias("beat"))
    open_ = V.settled(blocks.filter(F.col("turn") > FIRST_BLOCKS).join(beat, "query_id", "left").filter(F.col("most") >= F.coalesce("beat", F.lit(0.0)) - ROOM).select("query_id", "seg", "block"))
    if open_.head(1):
        hits = top(hits.drop("rank").unionByName(scored(open_)))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")
