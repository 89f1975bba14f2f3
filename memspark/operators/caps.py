"""Greedy degree caps: edges in a fixed order, each kept while both of its ends have room.

What one pass over all edges gives, without one task that holds them. Edges that come first at both ends are decided
together in rounds of joins; where rounds get nowhere (a clique in the order of its names decides a few edges a
round), the next ONE_PASS edges of the order are decided in one task, and edges of full nodes never come back. Nodes that
share groups are capped without forming their pairs: nodes are taken in chunks of the order, and a chunk meets only as
many later members of its groups as it can fill."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Edges that one task decides at most; nodes of a chunk.
ONE_PASS, CHUNK = 500_000, 50_000
_KEY = ["layer", "source_id", "target_id"]


def _used(kept: DataFrame) -> DataFrame:
    return kept.select("layer", F.explode(F.array("source_id", "target_id")).alias("_end")).groupBy("layer", "_end").agg(F.count("*").alias("_used"))


def _with_used(edges: DataFrame, used: DataFrame) -> DataFrame:
    for end in ("source_id", "target_id"):
        edges = edges.join(used.select("layer", F.col("_end").alias(end), F.col("_used").alias(f"_{end}")), ["layer", end], "left").fillna(0, [f"_{end}"])
    return edges


def _decide(most: int):
    def one_pass(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["weight", "source_id", "target_id"], ascending=[False, True, True])
        room: dict[str, int] = {}
        for end in ("source_id", "target_id"):
            room.update(zip(edges[end], most - edges[f"_{end}"]))
        kept = []
        for a, b in zip(edges["source_id"], edges["target_id"]):
            kept.append(room[a] > 0 and room[b] > 0)
            if kept[-1]:
                room[a] -= 1
                room[b] -= 1
        return edges.loc[kept, [*_KEY, "weight"]]

    return one_pass


def capped(edges: DataFrame, most: int, one_pass: int = ONE_PASS) -> DataFrame:
    """edges (layer, source_id, target_id, weight): those that are kept by weight (heaviest first), then ends; `most` a node.

    Repeated edges count once (the heaviest). Rounds, each with checkpoints: edges that come first at both of their ends, among as many
    as those still have room for, are kept; those of full nodes go. Once one_pass edges are left, or a round decides under
    an eighth of them, the first one_pass of the order are decided in one task a layer."""
    left = cut(edges.groupBy(*_KEY).agg(F.max(F.col("weight").cast("double")).alias("weight")))
    kept, n, stuck = cut(left.limit(0)), left.count(), False
    while n:
        used = cut(_used(kept))
        met = _with_used(left, used)
        if n <= one_pass or stuck:
            first = met if n <= one_pass else cut(met.orderBy(F.desc("weight"), "source_id", "target_id", "layer").limit(one_pass))
            new = first.groupBy("layer").applyInPandas(_decide(most), left.schema)
            undecided = left.join(first.select(*_KEY), _KEY, "left_anti") if n > one_pass else left.limit(0)
        else:
            ends = met.select("*", F.inline(F.array(*[F.struct(F.col(e).alias("_end"), (most - F.col(f"_{e}")).alias("_room")) for e in ("source_id", "target_id")])))
            w = Window.partitionBy("layer", "_end").orderBy(F.desc("weight"), "source_id", "target_id")
            ranked = ends.withColumn("_k", F.row_number().over(w))
            state = cut(ranked.groupBy(*_KEY, "weight").agg(F.bool_and(F.col("_k") <= F.col("_room")).alias("_in")))
            new, undecided = state.where("_in").drop("_in"), state.where("not _in").drop("_in")
        kept = cut(kept.unionByName(new))
        full = _used(kept).where(F.col("_used") >= most)
        for end in ("source_id", "target_id"):
            undecided = undecided.join(full.select("layer", F.col("_end").alias(end)), ["layer", end], "left_anti")
        left = cut(undecided.select(*_KEY, "weight"))
        before, n = n, left.count()
        stuck = 8 * (before - n) < before
    return kept


def _links_of(nodes: list[tuple[int, list]], later: list[tuple], room: dict[int, int], most: int) -> tuple[list[tuple[int, int]], int | None]:
    """nodes: (place, groups) in order; later: (group, place, whether it only marks that more follow). Links, and the place to go on from.

    A node whose groups' later members end before it is full is left for the next chunk."""
    members, more = defaultdict(list), {}
    for at, groups in nodes:
        for g in groups:
            members[g].append(at)
    for g, at, mark in sorted(later):
        if mark:
            more[g] = at
        else:
            members[g].append(at)
    skip = {g: list(range(len(m) + 1)) for g, m in members.items()}

    def alive(g: str, i: int) -> int:
        """The first member from i on that has room; paths to it are shortened."""
        path, places, jump = [], members[g], skip[g]
        while i < len(places) and (jump[i] > i or room.get(places[i], most) <= 0):
            path.append(i)
            i = jump[i] if jump[i] > i else i + 1
        for p in path:
            jump[p] = i
        return i

    def after(g: str, at: int) -> Iterator[tuple[int, bool]]:
        i = alive(g, bisect_right(members[g], at))
        while i < len(members[g]):
            yield members[g][i], False
            i = alive(g, i + 1)
        if g in more:
            yield more[g], True

    links = []
    for at, groups in nodes:
        own, last = [], None
        if room.get(at, most) > 0:
            for b, mark in heapq.merge(*(after(g, at) for g in groups)):
                if mark:
                    return links, at
                if b != last:
                    own.append(b)
                    last = b
                if len(own) == room.get(at, most):
                    break
        for b in own:
            room[b] = room.get(b, most) - 1
        room[at] = room.get(at, most) - len(own)
        links += [(at, b) for b in own]
    return links, None


def capped_groups(members: DataFrame, most: int, chunk: int = CHUNK) -> DataFrame:
    """members (layer, node_id, group): pairs of nodes of a layer that share a group, kept in the order of their names; `most` a node.

    Pairs are never formed as a table: a chunk of nodes meets, of each of its groups, 2 x most later members for each
    member in the chunk, that have room; if that doesn't do, the chunk ends there and the next starts at that node."""
    held = members.where("group is not null").groupBy("layer", "node_id").agg(F.collect_set("group").alias("groups"))
    # After a sort by range, ids that grow by partition and row are places in the order.
    nodes = cut(held.orderBy("layer", "node_id").withColumn("at", F.monotonically_increasing_id()))
    posts = cut(nodes.select("at", F.explode("groups").alias("group"), "layer").select("at", F.struct("layer", "group").alias("group")))
    used, links, start = cut(nodes.select("at", F.lit(0).alias("used")).limit(0)), None, 0
    schema = "a long, b long"
    while True:
        current = cut(nodes.where(F.col("at") >= start).orderBy("at").limit(chunk).select("at"))
        n, last = current.agg(F.count("*"), F.max("at")).first()
        if not n:
            break
        here = posts.where(F.col("at").between(start, last))
        wanted = here.groupBy("group").agg((F.count("*") * 2 * most).alias("wanted"))
        later = posts.where(F.col("at") > last).join(wanted, "group").join(used.where(F.col("used") >= most).select("at"), "at", "left_anti")
        later = later.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy("at"))).where(F.col("k") <= 2 * most * chunk + 1).where(F.col("k") <= F.col("wanted") + 1)
        rows = here.select("group", "at", F.lit(False).alias("later"), F.lit(False).alias("mark")).unionByName(later.select("group", "at", F.lit(True).alias("later"), (F.col("k") > F.col("wanted")).alias("mark")))
        rows = rows.join(used, "at", "left").fillna(0, ["used"]).select(F.concat_ws("\u0000", "group.layer", "group.group").alias("group"), "at", "later", "mark", "used")

        def one_pass(rows: pd.DataFrame) -> pd.DataFrame:
            room = {int(a): most - int(u) for a, u in zip(rows["at"], rows["used"])}
            groups = defaultdict(list)
            for g, a in rows.loc[~rows["later"], ["group", "at"]].itertuples(index=False):
                groups[int(a)].append(g)
            behind = [(g, int(a), bool(m)) for g, a, m in rows.loc[rows["later"], ["group", "at", "mark"]].itertuples(index=False)]
            found, stop = _links_of(sorted(groups.items()), behind, room, most)
            return pd.DataFrame(found + ([(stop, -1)] if stop is not None else []), columns=["a", "b"], dtype="int64")

        # Rows are bounded by the chunk, so one group may hold them.
        found = cut(rows.withColumn("chunk", F.lit(0)).groupBy("chunk").applyInPandas(one_pass, schema))
        stop = found.where("b < 0").agg(F.max("a")).first()[0]
        new = found.where("b >= 0")
        links = new if links is None else cut(links.unionByName(new))
        start = stop if stop is not None else last + 1
        steps = new.select(F.explode(F.array("a", "b")).alias("at"), F.lit(1).alias("used"))
        used = cut(used.unionByName(steps).where(F.col("at") >= start).groupBy("at").agg(F.sum("used").cast("int").alias("used")))
    named = lambda k, c: nodes.select(F.col("at").alias(k), F.col("node_id").alias(c), *(["layer"] if k == "a" else []))
    if links is None:
        return nodes.select("layer", F.col("node_id").alias("source_id"), F.col("node_id").alias("target_id")).limit(0)
    return links.join(named("a", "source_id"), "a").join(named("b", "target_id"), "b").select("layer", "source_id", "target_id")
