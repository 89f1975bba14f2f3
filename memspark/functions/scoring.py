"""Scores and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def actr(now: Column, last_access: Column, count: Column, decay: float = 0.5) -> Column:
    """Activation in 0..1 from how often and how long ago something was used; unused: 0."""
    age = F.greatest(now - last_access, F.lit(0))
    raw = 1 - F.exp(-(F.log1p(count) - decay * F.log1p(age)))
    return F.when(count <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def recency(now: int, created_at: Column) -> Column:
    """1 to 1.5: half of the bonus is gone after 30 days; unknown times get none."""
    age = F.greatest(F.lit(now) - created_at, F.lit(0)) / 86_400
    return F.coalesce(1 + 0.5 * F.pow(F.lit(0.5), age / 30), F.lit(1.0))


def minmax(score: Column, over: WindowSpec, low: float = 0.0, high: float = 1.0, flat: float | None = None) -> Column:
    """Scaled to low..high within a window; equal scores all get `flat` (high unless given)."""
    a, b = F.min(score).over(over), F.max(score).over(over)
    return F.when(b - a < 1e-12, F.lit(high if flat is None else flat)).otherwise(low + (high - low) * (score - a) / (b - a))


def inhibited(score: Column, over: WindowSpec, beta: float = 0.15, most: int = 7) -> Column:
    """Score less beta times its distances to the `most` strictly stronger scores of the window, 0 at least.

    The window must be bounded by what is ranked together (a query's candidates, a node's edges)."""
    strong = F.slice(F.filter(F.sort_array(F.collect_list(score).over(over), asc=False), lambda v: v > score), 1, most)
    return F.greatest(F.lit(0.0), score - beta * F.aggregate(strong, F.lit(0.0), lambda a, v: a + (v - score)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def sign_bits(vector: Column) -> Column:
    """The signs of up to 64 components as one long, first component in the highest place."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(0).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def bit_jaccard(a: Column, b: Column) -> Column:
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either > 0, F.bit_count(a.bitwiseAND(b)) / either).otherwise(0.0)


def int8(vector: Column) -> tuple[Column, Column]:
    """Scale and whole numbers in -127..127; the error of a component is at most scale/127."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return top, F.transform(vector, lambda x: F.when(top > 0, F.round(x.cast("double") / top * 127)).otherwise(0.0).cast("int"))


def hill(shares: Column, order: float = 2.0) -> Column:
    """Effective number of sources, as an aggregate over shares that sum to one."""
    return F.pow(F.sum(F.pow(shares, F.lit(order))), F.lit(1 / (1 - order)))


def ndcg(relevance: Column, position: Column) -> Column:
    """Discounted gain, as an aggregate; divide by that of the ideal order."""
    return F.sum(relevance / F.log2(position + 1))


def query_window(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def floored(score: Column, over: WindowSpec) -> Column:
    """max(0, score) as a share of the window's best; 0 where none is over 0."""
    top = F.max(score).over(over)
    return F.when(top > 0, F.greatest(F.lit(0.0), score) / top).otherwise(0.0)


def binary_words(vector: Column, thresholds: Column) -> Column:
    """Bits (component over its threshold) of a vector of any length as longs of 64, first component highest; the last is filled with zeros."""
    bits = F.zip_with(vector, thresholds, lambda x, t: F.when(x.cast("double") > t, F.lit(1)).otherwise(0).cast("long"))
    words = F.sequence(F.lit(0), F.ceil(F.size(vector) / 64).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.coalesce(F.get(bits, w * 64 + i), F.lit(0).cast("long")))))


def weighted_hamming(a: Column, b: Column, weights: Column) -> Column:
    """a and b: arrays of 0 and 1. 1 less the weight of the bits that differ as a share of all weights; 0 without weights."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    off = F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: (x != y).cast("double")), weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, 1 - off / total).otherwise(0.0)


def learned_thresholds(pairs, candidates: int = 50):
    """pairs (a, b: vectors of the same meaning): for each dimension the one of `candidates` evenly spaced thresholds that puts
    most pairs on one side, the least of equals: dim, k (its number) and threshold. Sums for all come from one pass."""
    d = pairs.select(F.posexplode(F.arrays_zip("a", "b")).alias("dim", "p")).select("dim", F.col("p.a").cast("double").alias("x"), F.col("p.b").cast("double").alias("y"))
    ends = d.groupBy("dim").agg(F.min(F.least("x", "y")).alias("lo"), F.max(F.greatest("x", "y")).alias("hi"))
    t = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / (candidates - 1)
    agree = [F.count_if((F.col("x") > t(k)) == (F.col("y") > t(k))).alias(f"c{k}") for k in range(candidates)]
    sums = d.join(F.broadcast(ends), "dim").groupBy("dim", "lo", "hi").agg(*agree)
    best = F.array_position(F.array(*[f"c{k}" for k in range(candidates)]), F.greatest(*[f"c{k}" for k in range(candidates)])).cast("int") - 1
    return sums.withColumn("k", best).select("dim", "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (candidates - 1)).alias("threshold"))
