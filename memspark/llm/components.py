"""Connected components by alternating star contractions, all on Spark.

Each round replaces links by links to smaller nodes (first around each smaller
end, then around each larger end) until every component is a star around its
smallest node. Links never meet on the driver, minima are pre-aggregated before
the shuffle, and the few nodes that have very many links get theirs by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_LEAST, cut, join_hot


def _signature(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 20))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: longs a and b, in any order, repeats and loops allowed; rows with a null are no links.

    Returns one row per node with a link to another node: node, component (the smallest
    node that it reaches). An empty input gives no rows. Raises if max_rounds don't do."""
    links = cut(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") < F.col("b")).alias("up"))
        .filter("a < b and up is not null")
        .select("a", "b")
        .distinct()
    )
    before = _signature(links)
    for _ in range(max_rounds if before[0] else 0):
        low = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        lifted = join_hot(links, low.withColumnRenamed("node", "a"), "a", "left", before[0]).select(F.coalesce("low", "a").alias("a"), "b")
        lifted = cut(lifted) if before[0] > HOT_LEAST else lifted
        least = lifted.groupBy("b").agg(F.min("a").alias("low"))
        pairs = F.array(F.struct(F.col("low").alias("a"), F.col("b").alias("b")), F.struct(F.col("low").alias("a"), F.col("a").alias("b")))
        links = cut(join_hot(lifted, least, "b", "inner", before[0]).select(F.inline(pairs)).filter("a < b").distinct())
        after = _signature(links)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
