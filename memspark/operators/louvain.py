"""Communities by modularity: local moves in parallel and contraction of levels.

In a round a node may join the community of a neighbour that raises modularity most. All nodes at once would swap
places for ever, so a round moves those nodes alone that come before all of their neighbours in an order drawn anew for the round from
hashes (no two of them are neighbours); the same rows give the same result however they are dealt out. When moves no
longer help, communities become the nodes of the next level, their edges summed. What a node sees of a community is
summed before the shuffle, so hubs are no hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Least gain of modularity of a sweep (ROUNDS rounds) and of a level that goes on; rounds of a sweep, sweeps and levels at most.
LEAST_GAIN, ROUNDS, SWEEPS, LEVELS = 1e-5, 3, 12, 10


def _undirected(edges: DataFrame, weight: str) -> DataFrame:
    """a <= b, w: parallel and opposite edges summed. Edges without an end or a positive weight don't count."""
    e = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.col(weight).cast("double").alias("w"), (F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).alias("whole"))
    return e.where("whole and w > 0").groupBy("a", "b").agg(F.sum("w").alias("w"))


def _ends(links: DataFrame) -> DataFrame:
    """node, other, w in both directions; a loop once with twice its weight, as modularity counts it."""
    loop = F.col("a") == F.col("b")
    return links.select(F.inline(F.when(loop, F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), (2 * F.col("w")).alias("w")))).otherwise(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), F.col("w").alias("w")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), F.col("w").alias("w"))))))


def modularity(edges: DataFrame, communities: DataFrame, weight: str = "weight") -> float:
    """Of a partition (node, community) of the edges (source_id, target_id, weight); 0 without edges."""
    return _modularity(_ends(_undirected(edges, weight)), communities)


def _modularity(ends: DataFrame, labels: DataFrame) -> float:
    of = ends.join(labels, "node").join(labels.select(F.col("node").alias("other"), F.col("community").alias("there")), "other")
    sums = of.groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("there"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total"))
    inside, squares, total = sums.agg(F.sum("inside"), F.sum(F.col("total") * F.col("total")), F.sum("total")).first()
    return inside / total - squares / total**2 if total else 0.0


def _turn(node: str, at: int) -> Column:
    return F.struct(F.xxhash64(F.lit(at), node), F.col(node))


def _round(ends: DataFrame, degrees: DataFrame, labels: DataFrame, total: float, at: int) -> DataFrame:
    """labels after the moves of the nodes that come before their neighbours in this round's order."""
    others = ends.where("node <> other")
    first = others.groupBy("node").agg(F.min(_turn("other", at)).alias("_o")).where(_turn("node", at) < F.col("_o")).select("node")
    mine = first.join(degrees, "node").join(labels, "node")
    size = degrees.join(labels, "node").groupBy("community").agg(F.sum("k").alias("size"))
    near = others.join(first, "node", "left_semi").join(labels.select(F.col("node").alias("other"), F.col("community").alias("there")), "other")
    seen = near.groupBy("node", F.col("there").alias("community")).agg(F.sum("w").alias("w"))
    # The own community is a choice even if no neighbour is in it.
    choice = seen.unionByName(mine.select("node", "community", F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
    met = choice.join(mine.select("node", "k", F.col("community").alias("own")), "node").join(size, "community")
    here = F.col("community") == F.col("own")
    gain = F.round(F.col("w") - F.col("k") * (F.col("size") - F.when(here, F.col("k")).otherwise(0.0)) / total, 9)
    # The best gain; of equal ones the own community, else the least name.
    best = met.select("node", "community", gain.alias("g"), here.alias("h")).groupBy("node").agg(F.min_by("community", F.struct(-F.col("g"), ~F.col("h"), F.col("community"))).alias("_new"))
    return labels.join(best, "node", "left").select("node", F.coalesce("_new", "community").alias("community"))


def louvain(edges: DataFrame, weight: str = "weight", sweeps: int = SWEEPS, levels: int = LEVELS) -> DataFrame:
    """edges (source_id, target_id, weight): node and community (the least node in it) of each node with an edge.

    Directions, and rows that repeat, are summed; loops count; an empty table gives no rows."""
    links = cut(_undirected(edges, weight))
    ends = cut(_ends(links))
    nodes = cut(ends.select("node").distinct())
    total = ends.agg(F.sum("w")).first()[0]
    found = nodes.select("node", F.col("node").alias("community"))
    if not total:
        return found
    best, at = _modularity(ends, found), 0
    for _ in range(levels):
        degrees = cut(ends.groupBy("node").agg(F.sum("w").alias("k")))
        labels, before = cut(degrees.select("node", F.col("node").alias("community"))), best
        for _ in range(sweeps):
            moved = labels
            for _ in range(ROUNDS):
                moved, at = cut(_round(ends, degrees, moved, total, at)), at + 1
            now = _modularity(ends, moved)
            if now < best + LEAST_GAIN:
                break
            labels, best = moved, now
        if best < before + LEAST_GAIN:
            break
        up = labels.select(F.col("node").alias("community"), F.col("community").alias("_c"))
        found = cut(found.join(up, "community").select("node", F.col("_c").alias("community")))
        of = lambda k: labels.select(F.col("node").alias(k), F.col("community").alias(f"c{k}"))
        up = links.join(of("a"), "a").join(of("b"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w")
        links = cut(up.groupBy("a", "b").agg(F.sum("w").alias("w")))
        ends = cut(_ends(links))
    named = found.groupBy("community").agg(F.min("node").alias("_least"))
    return found.join(named, "community").select("node", F.col("_least").alias("community"))


def insights(communities: DataFrame, words: DataFrame, most: int = 10, least: int = 3, each: int = 3) -> DataFrame:
    """The `most` largest communities of `least` nodes or more with the words that mark them. words (node, words).

    Returns community, n, token, tf, ratio and place; see aggregates.distinguishing."""
    from . import aggregates as ag

    sizes = communities.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = cut(sizes.orderBy(F.desc("n"), "community").limit(most))
    told = ag.distinguishing(communities.join(words, "node"), "community", "words", each)
    return told.join(F.broadcast(top), "community").select("community", "n", "token", "tf", "ratio", "place")
