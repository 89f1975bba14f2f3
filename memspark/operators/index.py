"""A stored index of pages that grows by batches: ingest, segments, merging and search by words, bits or both.

A store is a folder. Each batch adds a segment, a folder in each of three Parquet tables: pages (deduplicated by user and hash of their
content), chunks (with the bits of their vectors) and postings (dealt by a hash of the term, sorted by term). A manifest says
which segments count and how many pages and words they hold; it is written last, so a batch that fails leaves
nothing behind that is read. Searches read the buckets of the asked terms alone, and lengths come with the postings, so no page is
read before the hits are known. Merging writes all segments as one."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..lineage import cut
from . import retrieval as rt
from . import windows as wn

#: Buckets that postings are dealt into; terms that are named to the scan (more are joined).
BUCKETS, NAMED_TERMS = 64, 1000
#: Pages of a task that splits them, words of a task that writes their postings, pages whose words are counted at once.
TASK_PAGES, TASK_WORDS, COUNTED = 2_500, 500_000, 256
DIM, FUSED = 384, 3
PAGES = "page_id long, user_id string, title string, content string, hash string, dl int, chunks array<string>"
CHUNKS = "page_id long, user_id string, chunk int, content string, bits array<long>"
POSTINGS = "term string, page_id long, user_id string, tf long, dl int, bucket int"
_MANIFEST = "version int, segments array<string>, n long, words long"


@F.pandas_udf(T.ArrayType(T.LongType()))
def hash_bits(texts: pd.Series) -> pd.Series:
    """The signs of a text's hash vector (stores.hash_vector), 64 to a number, the first the highest. All texts of a batch at once."""
    raw = b"".join(hashlib.sha512((t or "").lower().encode()).digest() for t in texts)
    values = np.frombuffer(raw, "<f4").reshape(len(texts), -1)
    finite = np.isfinite(values)
    # Numbers that aren't finite are left out, so the others move up.
    order = np.argsort(~finite, axis=1, kind="stable")
    signs = np.zeros((len(texts), DIM), bool)
    signs[:, : values.shape[1]] = np.take_along_axis(finite & (np.where(finite, values, 0) > 0), order, 1)
    return pd.Series(list(np.packbits(signs, axis=1).view(">u8").astype(np.int64)), dtype=object)


def create(spark: SparkSession, folder: str) -> str:
    """An empty store in folder (a path that all executors reach)."""
    _commit(spark, folder, (0, [], 0, 0))
    return folder


def _commit(spark: SparkSession, folder: str, row: tuple) -> None:
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> tuple[int, list[str], int, int]:
    """version, segments, pages and words of a store as it is now."""
    return tuple(spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").orderBy(F.desc("version")).first())


def _read(spark: SparkSession, folder: str, segments: list[str], table: str, schema: str) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], schema)
    found = spark.read.option("basePath", f"{folder}/{table}").schema(f"{schema}, segment string")
    return found.parquet(*[f"{folder}/{table}/segment={s}" for s in segments]).drop("segment")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, manifest(spark, folder)[1], "pages", PAGES)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, manifest(spark, folder)[1], "chunks", CHUNKS)


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, manifest(spark, folder)[1], "postings", POSTINGS)


def _write_postings(counts: DataFrame, path: str, words: int) -> None:
    """By bucket and term; tasks follow the number of words, and where a bucket has several its pages are dealt among them, so a term of very many pages spreads.

    Rows are dealt once, by hash: ranges would be sampled, for which all counts are worked out twice."""
    tasks = max(1, math.ceil(words / TASK_WORDS))
    part = F.pmod(F.xxhash64("page_id"), F.lit(math.ceil(tasks / BUCKETS)))
    rows = counts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    rows.repartition(tasks, "bucket", part).sortWithinPartitions("bucket", "term", "page_id").write.partitionBy("bucket").parquet(path)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their words (terms) as rows of POSTINGS. A page is one row, so its words are counted where it is."""
    for batch in batches:
        for i in range(0, len(batch), COUNTED):
            some = batch.slice(i, COUNTED)
            lists = some.column("terms")
            met = pa.table({"page": pc.list_parent_indices(lists), "term": lists.flatten()}).group_by(["page", "term"], use_threads=False).aggregate([([], "count_all")])
            own = some.select(["page_id", "user_id", "dl"])
            for part in met.combine_chunks().to_batches():
                rows = own.take(part.column("page"))
                yield pa.RecordBatch.from_arrays([part.column("term"), rows.column("page_id"), rows.column("user_id"), part.column("count_all").cast(pa.int64()), rows.column("dl")], ["term", "page_id", "user_id", "tf", "dl"])


def ingest(docs: DataFrame, folder: str, bits: Callable[[Column], Column] = hash_bits, most: int = 500, overlap: int = 100) -> int:
    """Adds docs (page_id, user_id, title, content) as a segment; returns how many are new.

    Of equal contents of a user the smallest page_id of the batch comes in, none if the store has it. Texts without
    chunks (null, empty, blank) stay out. page_id names a page; null users are one user."""
    spark = docs.sparkSession
    version, segments, n, words = manifest(spark, folder)
    given = docs.select("page_id", "user_id", "title", "content").where("page_id is not null and content is not null").withColumn("hash", F.sha2("content", 256))
    owner = F.coalesce("user_id", F.lit("")).alias("_u")
    first = given.groupBy(owner, "hash").agg(F.min("page_id").alias("page_id"))
    known = _read(spark, folder, segments, "pages", PAGES).select(owner, "hash")
    # Of a page_id that repeats one content comes in. Contents are dealt out once, to as many tasks as their number asks for.
    wanted = cut(first.join(known, ["_u", "hash"], "left_anti").groupBy("page_id").agg(F.min("hash").alias("hash")))
    tasks = max(1, math.ceil(wanted.count() / TASK_PAGES))
    dealt = lambda df: df.repartition(tasks, "page_id", "hash")
    split = dealt(given).join(dealt(wanted), ["page_id", "hash"], "left_semi").dropDuplicates(["page_id", "hash"]).withColumn("chunks", tx.chunks(most, overlap)(F.col("content"))).where("size(chunks) > 0")
    term_list = F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "content")), F.lit(tx.WORD), 1)
    segment = f"{version + 1:06}-{uuid.uuid4().hex}"
    path = lambda table: f"{folder}/{table}/segment={segment}"
    split.select("page_id", "user_id", "title", "content", "hash", F.size(term_list).alias("dl"), "chunks").write.parquet(path("pages"))
    new = spark.read.schema(PAGES).parquet(path("pages"))
    added, more = new.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if not added:
        return 0
    new.select("page_id", "user_id", F.posexplode("chunks").alias("chunk", "content")).withColumn("bits", bits(F.col("content"))).write.parquet(path("chunks"))
    counts = new.select("page_id", "user_id", "dl", term_list.alias("terms")).mapInArrow(_term_counts, POSTINGS.removesuffix(", bucket int"))
    _write_postings(counts, path("postings"), more)
    _commit(spark, folder, (version + 1, [*segments, segment], n + added, words + more))
    return added


def merge(spark: SparkSession, folder: str) -> None:
    """All segments as one; the old ones stay until they are removed from outside, so running searches end well."""
    version, segments, n, words = manifest(spark, folder)
    if len(segments) < 2:
        return
    segment = f"{version + 1:06}-{uuid.uuid4().hex}"
    for table, schema in (("pages", PAGES), ("chunks", CHUNKS)):
        _read(spark, folder, segments, table, schema).write.parquet(f"{folder}/{table}/segment={segment}")
    _write_postings(_read(spark, folder, segments, "postings", POSTINGS).drop("bucket"), f"{folder}/postings/segment={segment}", words)
    _commit(spark, folder, (version + 1, [segment], n, words))


def by_words(spark: SparkSession, folder: str, queries: DataFrame, user: str | None = None) -> DataFrame:
    """query_id, page_id, score: BM25 of all pages with a term of the query. queries: query_id, query."""
    _, segments, n, words = manifest(spark, folder)
    held = _read(spark, folder, segments, "postings", POSTINGS)
    terms = queries.select(F.explode(tx.tokens(F.col("query"), 1)).alias("term")).distinct().limit(NAMED_TERMS + 1).collect()
    if len(terms) <= NAMED_TERMS:
        names = sorted(r.term for r in terms)
        buckets = [r.b for r in spark.createDataFrame([(t,) for t in names], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
        held = held.where(F.col("bucket").isin(buckets) & F.col("term").isin(names))
    if user is not None:
        held = held.where(F.col("user_id") == user)
    stats = spark.createDataFrame([(n, words / n if n else 0.0)], "n long, avgdl double")
    return rt.bm25(held.select("term", "page_id", "tf", "dl"), stats, queries, "page_id")


def by_bits(spark: SparkSession, folder: str, queries: DataFrame, limit: int, bits: Callable[[Column], Column] = hash_bits, user: str | None = None) -> DataFrame:
    """query_id, page_id, score of the nearest pages: 1 - Hamming distance / dimensions of their nearest chunk. Chunks meet queries in blocks."""
    c = chunks(spark, folder)
    c = c if user is None else c.where(F.col("user_id") == user)
    asked = cut(queries.select("query_id", bits(F.col("query")).alias("v")).withColumn("id", F.monotonically_increasing_id()))

    def scores(v: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
        x, y = (np.vstack(p["v"].to_numpy()).astype(np.int64) for p in (v, q))
        far = np.zeros((len(x), len(y)), np.int64)
        for k in range(x.shape[1]):
            far += np.bitwise_count((x[:, k, None] ^ y[:, k]).view(np.uint64))
        # The nearest chunk of a page stands for it within the block.
        pages = v["id"].to_numpy()
        order = np.argsort(pages, kind="stable")
        starts = np.flatnonzero(np.r_[True, pages[order][1:] != pages[order][:-1]])
        best = np.minimum.reduceat(far[order], starts)
        out = np.full_like(far, -(1 << 30))
        out[order[starts]] = -best
        return out

    # Blocks are dealt by page, so a page's chunks lie in one.
    near = rt.nearest(c.select(F.col("page_id").alias("id"), F.col("bits").alias("v")), asked.select("id", "v"), scores, limit, "long")
    named = near.where("score > -1000000").withColumnRenamed("query_id", "id").join(F.broadcast(asked.select("id", "query_id")), "id")
    found = named.select("query_id", F.col("vec_id").alias("page_id"), (1 + F.col("score") / DIM).alias("score"))
    return wn.newest(found, ["query_id"], limit, F.desc("score"), F.asc("page_id"))


def strategy_of(query: Column) -> Column:
    """fts for queries of at most two words, else hybrid."""
    words = F.size(F.filter(F.split(F.coalesce(query, F.lit("")), "\\s+"), lambda w: w != ""))
    return F.when(words <= 2, "fts").otherwise("hybrid")


def search(spark: SparkSession, folder: str, queries: DataFrame, strategy: str = "auto", limit: int = 10, user: str | None = None) -> DataFrame:
    """The best `limit` pages of each query (query_id, page_id, score, source): by words (fts), bits (mib), both fused by rank (hybrid), or as strategy_of() says (auto)."""
    if strategy not in ("fts", "mib", "hybrid", "auto"):
        raise ValueError(f"unknown strategy: {strategy}")
    q = queries.withColumn("_s", strategy_of(F.col("query")) if strategy == "auto" else F.lit(strategy)).select("query_id", "query", "_s")
    parts = []
    if strategy in ("fts", "auto"):
        some = q.where("_s = 'fts'")
        best = rt.top(by_words(spark, folder, some, user), ["query_id"], "page_id", limit)
        parts.append(best.select("query_id", "page_id", F.round("score", 6).alias("score"), F.lit("fts").alias("source")))
    if strategy == "mib":
        parts.append(by_bits(spark, folder, q, limit, user=user).withColumn("source", F.lit("mib")))
    if strategy in ("hybrid", "auto"):
        some = q.where("_s = 'hybrid'")
        words = rt.top(by_words(spark, folder, some, user), ["query_id"], "page_id", FUSED * limit).withColumn("score", F.round("score", 6))
        fused = wn.reciprocal_ranks({"fts": words, "mib": by_bits(spark, folder, some, FUSED * limit, user=user)}, ["query_id"], "page_id")
        best = rt.top(fused, ["query_id"], "page_id", limit)
        parts.append(best.select("query_id", "page_id", F.round("score", 6).alias("score"), F.col("found_by").alias("source")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found
