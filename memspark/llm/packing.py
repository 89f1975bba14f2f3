"""Best-fit packing of documents into training sequences, under conflicts.

Texts are cut into pieces of at most a sequence's length. Equal pieces are counted
and numbered, and pieces are dealt by a hash of themselves and that number to shards
of bounded size, so rows that repeat spread like others. Each shard is packed on its
own, longest pieces first. Its open bins stand in order of what is left in them and carry bitmaps of
the sources and duplicate clusters they hold; the search starts at the tightest
bin that is large enough and goes on to its successors until a bin holds neither
the piece's source nor its cluster. No bin of that kind: a new one is opened."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .mixing import token_count

CAPACITY = 2048
#: Pieces of a shard, on average. Shards are as many as the input needs.
SHARD_PIECES = 2048
RESULT = "doc_id {id}, piece int, n_tokens long, bin_id long, start long"


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """pieces: (tokens, source, cluster), in the order of packing; a null source or cluster conflicts with none.

    Returns (bin, first token's place in it) of each. Ties of residuals go to the oldest bin."""
    bits: dict[tuple[int, object], int] = {}
    bit = lambda kind, x: 0 if x is None else 1 << bits.setdefault((kind, x), len(bits))
    residuals: list[tuple[int, int]] = []
    held: list[int] = []
    out = []
    for tokens, source, cluster in pieces:
        mine = bit(0, source) | bit(1, cluster)
        k = bisect_left(residuals, (tokens, -1))
        while k < len(residuals) and held[residuals[k][1]] & mine:
            k += 1
        left, at = residuals.pop(k) if k < len(residuals) else (capacity, len(held))
        if at == len(held):
            held.append(0)
        held[at] |= mine
        out.append((at, capacity - left))
        insort(residuals, (left - tokens, at))
    return out


def _pack_shard(table: pa.Table, capacity: int) -> pa.Table:
    rows = table.to_pydict()
    n = range(table.num_rows)
    order = sorted(n, key=lambda i: (-rows["n_tokens"][i], rows["doc_id"][i] is None, rows["doc_id"][i] or 0, rows["piece"][i], rows["source"][i] or "", rows["cluster"][i] or ""))
    placed = best_fit([(rows["n_tokens"][i], rows["source"][i], rows["cluster"][i]) for i in order], capacity)
    shard = rows["shard"][0] << 32
    done = {"bin_id": pa.array([shard + b for b, _ in placed], pa.int64()), "start": pa.array([s for _, s in placed], pa.int64())}
    kept = table.take(order).select(["doc_id", "piece", "n_tokens"])
    return kept.append_column("bin_id", done["bin_id"]).append_column("start", done["start"])


def packed(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """docs: doc_id, text, source. cluster: a string that copies share; by default copies are equal texts.

    Returns one row per piece: doc_id, piece (from 0), n_tokens, bin_id, start. No two pieces of a bin
    have the same source or cluster, and a bin holds capacity tokens at most. A text without words (or
    null) is one piece of 0 tokens and in no cluster; a null source or cluster conflicts with nothing.
    Repeated rows are pieces of their own (and copies). An empty table gives no rows."""
    tokens = token_count(F.col("text"))
    copy = F.md5("text") if cluster is None else cluster.cast("string")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), tokens.alias("_all"), copy.alias("cluster"))
    rows = rows.withColumn("cluster", F.when(F.col("_all") > 0, F.col("cluster")))
    last = F.greatest(F.ceil(F.col("_all") / capacity), F.lit(1)).cast("int") - 1
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    rows = rows.select("doc_id", "piece", F.least(F.lit(capacity), F.col("_all") - F.col("piece") * capacity).alias("n_tokens"), "source", "cluster")
    equal = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")))
    shards = max(1, -(-(equal.agg(F.sum("_n")).first()[0] or 0) // shard_pieces))
    # Numbers in two steps, so that no array is longer than the square root of the rows that are equal.
    part = F.ceil(F.sqrt("_n")).cast("long")
    steps = equal.withColumn("_part", part).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.col("_part"))))
    rows = steps.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + F.col("_part") - 1, "_n"))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "_k"), F.lit(shards)).cast("long")).drop("_n", "_part", "_from", "_k")
    schema = RESULT.format(id=docs.schema["doc_id"].dataType.simpleString())
    return rows.groupBy("shard").applyInArrow(lambda t: _pack_shard(t, capacity), schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
