"""Order-dependent operators: sessions, duplicates, chains, caps, fading thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (map-side combined, no sort)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def sessions(events: DataFrame, keys: list[str], at: str = "ts", gap: int = 1800, tie: str = "log_id") -> DataFrame:
    """events with session_no: a new one begins after more than `gap` seconds without an event."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("long"), F.lit(1))
    return events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def session_spans(events: DataFrame, keys: list[str], at: str = "ts", gap: int = 1800) -> DataFrame:
    return sessions(events, keys, at, gap).groupBy(*keys, "session_no").agg(F.min(at).alias("start_ts"), F.max(at).alias("end_ts"), F.count("*").alias("n_events"))


def merge_ranked(hits: DataFrame, now: int, keys: list[str], limit: int) -> DataFrame:
    """hits (keys, source, native_id, score, created_at): scaled within each source, lifted by recency, cut by rank."""
    scaled = hits.withColumn("score", sc.minmax(F.col("score"), Window.partitionBy(*keys, "source")) * sc.recency(now, F.col("created_at")))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 6)), "source", "native_id")
    return scaled.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def reciprocal_ranks(branches: dict[str, DataFrame], keys: list[str], ident: str, k: int = 60) -> DataFrame:
    """Fuses ranked lists (keys, ident, score): sum of 1/(k + rank + 1), ranks from 0; from: the lists that had it."""
    ranked = None
    for name, df in branches.items():
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), ident)
        one = df.select(*keys, ident, (F.row_number().over(w) - 1).alias("_r"), F.lit(name).alias("_from"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy(*keys, ident).agg(F.sum(1 / (F.lit(k + 1) + F.col("_r"))).alias("score"), F.array_join(F.array_sort(F.collect_set("_from")), "+").alias("found_by"))


def fading_threshold(scores: DataFrame, keys: list[str], order: list[str], score: str, start: float = 0.4, rate: float = 0.1) -> DataFrame:
    """A threshold that follows the scores, T' = (1 - rate) T + rate clamp(s, 0.1, 0.6), and whether each score passes T.

    The fold has a closed form, sum of rate (1 - rate)^(n - i) s_i, whose powers stay small within blocks of rows. A
    block is so long that of what came before it only the block before leaves a trace in double precision."""
    q = 1 - rate
    size = math.ceil(60 / -math.log(q))
    w = Window.partitionBy(*keys).orderBy(*order)
    n = scores.withColumn("_n", F.row_number().over(w) - 1).withColumn("_s", F.least(F.greatest(F.col(score), F.lit(0.1)), F.lit(0.6)))
    n = n.withColumn("_b", F.floor(F.col("_n") / size)).withColumn("_k", F.col("_n") % size)
    inside = Window.partitionBy(*keys, "_b")
    sofar = F.sum(F.col("_s") * F.pow(F.lit(q), -F.col("_k") - 1)).over(inside.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("_in", rate * F.pow(F.lit(q), F.col("_k")) * F.coalesce(sofar, F.lit(0.0)))
    n = n.withColumn("_all", rate * F.sum(F.col("_s") * F.pow(F.lit(q), size - 1 - F.col("_k"))).over(inside))
    last = F.first("_all").over(Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1))
    opened = F.when(F.col("_b") == 0, F.lit(start)).when(F.col("_b") == 1, last + start * q**size).otherwise(last)
    out = n.withColumn("threshold", F.col("_in") + F.pow(F.lit(q), F.col("_k")) * opened)
    return out.withColumn("passes", F.col(score) >= F.col("threshold")).drop("_n", "_s", "_b", "_k", "_in", "_all")


def chain_breaks(journal: DataFrame, keys: list[str], order: str, prev: str, own: str, recomputed: Column) -> DataFrame:
    """Rows at which a hash chain is broken: their own hash is wrong, or they don't name their predecessor's."""
    w = Window.partitionBy(*keys).orderBy(order)
    return journal.withColumn("_before", F.coalesce(F.lag(own).over(w), F.lit(""))).where((F.col("_before") != F.col(prev)) | (F.col(own) != recomputed)).drop("_before")


def newest(df: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def rate_limited(events: DataFrame, keys: list[str], at: str = "ts", seconds: int = 60, most: int = 10) -> DataFrame:
    """events with how many of their key fell into the last `seconds`, themselves included, and whether that is allowed."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds + 1, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= most)


def capped_per_period(events: DataFrame, keys: list[str], seconds: int, most: int, at: str = "ts", tie: str = "log_id") -> DataFrame:
    """events with allowed: the first `most` of their key in each period of `seconds`."""
    w = Window.partitionBy(*keys, F.floor(F.col(at) / seconds)).orderBy(at, tie)
    return events.withColumn("allowed", F.row_number().over(w) <= most)
