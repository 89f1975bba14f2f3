"""The knowledge graph: neighbours, miners that add edges, upkeep."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..lineage import cut, stored
from . import aggregates as ag
from . import distil
from . import joins as jn

HEAVIEST = 0.6
#: Bits of a sketch of a node's words.
SKETCH = 512


def neighbours(edges: DataFrame, members: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """start (node): each node reached within `depth` hops over edges whose ends are both members, with its least depth.

    Each hop is a join on the frontier, less what was seen; depth is small, so the loop builds one plan. Only the ends of
    the edges that a hop takes are looked up among the members, and only what it reaches is made distinct."""
    ids = members.select("node_id")
    links = jn.both_ways(edges)
    seen = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth"))
    front = seen.distinct()
    for k in range(1, depth + 1):
        inside = front.join(ids.withColumnRenamed("node_id", "node"), "node", "left_semi")
        step = inside.join(links, "node").select("origin", F.col("neighbour").alias("node"), F.lit(k).alias("depth")).distinct()
        step = step.join(ids.withColumnRenamed("node_id", "node"), "node", "left_semi").select("origin", "node", "depth")
        front = step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def reaches(edges: DataFrame, start: DataFrame, target: str, depth: int) -> DataFrame:
    """The least number of directed hops from each start node to the target, within depth."""
    front = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hops"))
    out = front.where(F.col("node") == target)
    for k in range(1, depth + 1):
        front = front.join(edges, front["node"] == edges["source_id"]).select("origin", F.col("target_id").alias("node"), F.lit(k).alias("hops")).distinct()
        out = out.unionByName(front.where(F.col("node") == target))
    return out.groupBy("origin").agg(F.min("hops").alias("hops"))


def shared_tags(tags: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """Nodes that share tags: weight 0.3 + 0.1 for each, 0.6 at most. Tags on more than most_nodes nodes can be left out."""
    t = tags.dropDuplicates(["node_id", "tag"])
    if most_nodes:
        rare = t.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") <= most_nodes).select("tag")
        t = t.join(rare, "tag", "left_semi")
    pairs = jn.pairs_sharing(t, "tag", "node_id", weigh=lambda n: _stepped(n, 0.4, 0.1))
    return pairs.select("a", "b", F.lit("tagged").alias("relation"), F.col("n").alias("weight"))


def _stepped(n: Column, first: float, step: float) -> Column:
    """first + step for each of n after one, HEAVIEST at most, of 6 digits: looked up, as rounding takes longer than making a pair."""
    values = [min(HEAVIEST, round(first + step * k, 6)) for k in range(round((HEAVIEST - first) / step) + 1)]
    return F.element_at(F.array(*map(F.lit, values)), F.least(n, F.lit(len(values))).cast("int"))


def topic_overlap(nodes: DataFrame, synonyms: Mapping[str, Sequence[str]], floor: float = 0.3) -> DataFrame:
    """Nodes that share at least two canonical words and are alike by floor or the robust threshold of all such pairs, if that is higher.

    Pairs alike by the floor share one of the rarest words of each (the first n - ceil(floor n) + 1 of n), so only nodes with
    such a word meet, in blocks, where _may_be_alike() sifts them: what is written are candidates, never all pairs. The threshold lies above the floor only if over half of all pairs with two words in common do.
    That can't be if the nodes with the two most frequent words alone make too many pairs; else all pairs are counted."""
    sets = stored(nodes.select("node_id", distil.canonical_tokens(F.col("content"), synonyms).alias("words")).where("size(words) > 0"))
    words = sets.select("node_id", F.explode("words").alias("token"))
    seen = cut(words.groupBy("token").agg(F.count("*").alias("df")))
    ranked = words.join(seen, "token").groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("_r"))
    ranked = stored(ranked.select("node_id", F.size("_r").alias("size"), F.transform("_r", lambda x: x["token"]).alias("words")))
    known = ranked.select("node_id", "size", "words", _sketch(F.transform("words", lambda w: F.xxhash64(w))).alias("sketch"))
    prefix = F.slice("words", 1, (F.col("size") - F.ceil(floor * F.col("size") - 1e-9) + 1).cast("int"))
    first = known.select("node_id", "size", "sketch", F.posexplode(prefix).alias("place", "token")).withColumn("token", F.xxhash64("token"))
    pairs = _met(stored(first), floor).distinct()
    side = lambda k: ranked.select(F.col("node_id").alias(k), F.col("words").alias(f"w{k}"))
    shared = F.size(F.array_intersect("wa", "wb"))
    strong = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", shared.alias("n"), (F.size("wa") + F.size("wb")).alias("s"))
    strong = cut(strong.where("n >= 2").select("a", "b", (F.col("n") / (F.col("s") - F.col("n"))).alias("weight")).where(F.col("weight") >= floor))
    tau = floor
    if _pairs_at_least(sets, seen) < 2 * strong.count():
        both = jn.pairs_sharing(words, "token", "node_id", 2)
        size = lambda k: ranked.select(F.col("node_id").alias(k), F.col("size").alias(f"s{k}"))
        every = cut(both.join(size("a"), "a").join(size("b"), "b").select((F.col("n") / (F.col("sa") + F.col("sb") - F.col("n"))).alias("weight")))
        tau = max(floor, ag.mad_threshold(every, "weight").first()["tau"] or floor)
    return strong.where(F.col("weight") >= tau).select("a", "b", F.lit("topic_overlap").alias("relation"), "weight")


@F.pandas_udf(T.BinaryType())
def _sketch(hashes: pd.Series) -> pd.Series:
    """SKETCH bits of a set of words: those of their hashes."""
    bit = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64) & (SKETCH - 1)
    owner = np.repeat(np.arange(len(hashes)), hashes.map(len))
    out = np.zeros((len(hashes), SKETCH // 8), np.uint8)
    np.bitwise_or.at(out, (owner, bit >> 3), (128 >> (bit & 7)).astype(np.uint8))
    return pd.Series([row.tobytes() for row in out], dtype=object)


def _met(rows: DataFrame, floor: float, block: int = 2048) -> DataFrame:
    """rows (token, node_id, size, place, sketch): a < b that share a token and may be alike by floor. Tokens of over `block` rows meet in pairs of blocks, others in groups of many tokens."""
    seen = cut(rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    groups = max(1, math.ceil((seen.agg(F.sum("n")).first()[0] or 0) / jn.ROWS_OF_TASK))
    held, kind = rows.join(seen, "token"), rows.schema["node_id"].dataType.simpleString()
    parts = F.ceil(F.col("n") / block).cast("int")
    small = held.where(F.col("n") <= block).withColumns({"_g": F.pmod("token", F.lit(groups)), "_c": F.lit(0), "_i": F.lit(0), "_j": F.lit(0)})
    dealt = held.where(F.col("n") > block).withColumn("_c", F.pmod(F.xxhash64("node_id"), parts).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), parts - 1)))
    large = dealt.withColumns({"_g": F.col("token"), "_i": F.least("_c", "_o"), "_j": F.greatest("_c", "_o")}).drop("_o")
    # Groups are told from tokens of the same number.
    cells = small.withColumn("_large", F.lit(False)).unionByName(large.withColumn("_large", F.lit(True))).drop("n")
    return cells.groupBy("_large", "_g", "_i", "_j").applyInArrow(lambda t: _may_be_alike(t, floor), f"a {kind}, b {kind}")


def _may_be_alike(t: pa.Table, floor: float) -> pa.Table:
    """Of the rows of each token the pairs (of blocks _i and _j) that may be alike by floor.

    Words are sorted alike in all nodes. If a shared word is the first that two nodes share, no more than the words from there on are shared,
    and each bit of one sketch that the other lacks is a word that isn't shared; so none that is alike is left out."""
    i, j = t["_i"][0].as_py(), t["_j"][0].as_py()
    t = t.select(["token", "node_id", "size", "place", "sketch", "_c"]).combine_chunks().sort_by([("token", "ascending"), ("node_id", "ascending")])
    token, size, block = (t[c].to_numpy() for c in ("token", "size", "_c"))
    rest = size - t["place"].to_numpy()
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(t), -1)
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    found = [np.zeros((2, 0), np.int64)]
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(t)]):
        rows = np.arange(low, high)
        left, right = (rows, rows) if i == j else (rows[block[low:high] == i], rows[block[low:high] == j])
        for k in range(0, len(left), 512):
            some = left[k : k + 512]
            need = np.ceil((size[some, None] + size[right]) * (floor / (1 + floor)) - 1e-6)
            ok = (rest[some, None] >= need) & (rest[right] >= need)
            if i == j:
                ok &= some[:, None] < right
            x, y = np.nonzero(ok)
            x, y, need = some[x], right[y], need[ok]
            most = np.minimum(size[x] - np.bitwise_count(sketch[x] & ~sketch[y]).sum(1, dtype=np.int64), size[y] - np.bitwise_count(sketch[y] & ~sketch[x]).sum(1, dtype=np.int64))
            keep = most >= need
            if keep.any():
                found.append(np.stack([x[keep], y[keep]]))
    x, y = np.concatenate(found, 1)
    names = t["node_id"].combine_chunks()
    a, b = names.take(pa.array(x)), names.take(pa.array(y))
    up = pc.less(a, b)
    out = pa.table({"a": pc.if_else(up, a, b), "b": pc.if_else(up, b, a)})
    return out.filter(pc.not_equal(out["a"], out["b"]))


def _pairs_at_least(sets: DataFrame, seen: DataFrame) -> int:
    """How many pairs share two words at least: those of the nodes with the most frequent word and the one most frequent beside it."""
    top = seen.orderBy(F.desc("df"), "token").first()
    if top is None:
        return 0
    beside = sets.where(F.array_contains("words", top["token"])).select(F.explode("words").alias("token")).where(F.col("token") != top["token"])
    n = beside.groupBy("token").count().agg(F.max("count")).first()[0] or 0
    return n * (n - 1) // 2


def co_retrieved(pairs: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """pairs (a, b), one row for each joint retrieval: an edge from `least` on; both ends must be members."""
    ids = members.select("node_id")
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n = n.join(ids.withColumnRenamed("node_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("node_id", "b"), "b", "left_semi")
    return n.select("a", "b", F.lit("co_recalled").alias("relation"), F.least(F.lit(HEAVIEST), 0.3 + 0.1 * F.col("n")).alias("weight"))


def co_cited(edges: DataFrame, least: int = 1) -> DataFrame:
    """Targets of the same source: weight 0.3 + 0.05 for each further one, 0.6 at most."""
    pairs = jn.pairs_sharing(edges.select("source_id", "target_id").distinct(), "source_id", "target_id", least, weigh=lambda n: _stepped(n, 0.3, 0.05))
    return pairs.select("a", "b", F.lit("co_cited").alias("relation"), F.col("n").alias("weight"))


def belief_gain(edges: DataFrame, confidence: DataFrame) -> DataFrame:
    """confidence (node_id, confidence): a tenth of the strongest confident edge into each node."""
    e = edges.join(confidence.withColumnRenamed("node_id", "source_id"), "source_id")
    return e.groupBy("target_id").agg((0.1 * F.max(F.col("confidence") * F.col("weight"))).alias("gain"))


def keep_heavier(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of edges: of equal (source, target, relation) the strictly heavier wins and brings its age; the old wins ties."""
    cols = ["source_id", "target_id", "relation", "weight", "created_at"]
    both = old.select(*cols, F.lit(1).alias("_old")).unionByName(new.select(*cols, F.lit(0).alias("_old")))
    best = F.max_by(F.struct("weight", "created_at"), F.struct("weight", "_old", F.negate("created_at")))
    return both.groupBy("source_id", "target_id", "relation").agg(best.alias("_b")).select("source_id", "target_id", "relation", "_b.*")


def validity(edges: DataFrame, now: int) -> DataFrame:
    """edges with status: expired outside the validity window."""
    from .filters import active

    return edges.withColumn("status", F.when(active(now), "active").otherwise("expired"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many edge ends each node has, 0 included; hubs made by the system don't count."""
    from .filters import not_hub

    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    return nodes.where(not_hub()).join(ends, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_anti")


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def delete_nodes(nodes: DataFrame, edges: DataFrame, tags: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and tags without the nodes in gone (node_id)."""
    left = edges.join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left, tags.join(gone, "node_id", "left_anti")


def dream_nrem(edges: DataFrame, now: int) -> DataFrame:
    """Edges of the last day gain 0.05, those over 30 days old lose 0.01; what falls under 0.05 goes."""
    age = (F.lit(now) - F.col("created_at")) / 86_400
    w = F.when(age <= 1, F.col("weight") + 0.05).when(age > 30, F.col("weight") - 0.01).otherwise(F.col("weight"))
    return edges.withColumn("weight", w).where("weight >= 0.05")


def inhibited_edges(edges: DataFrame, beta: float = 0.15, most: int = 7) -> DataFrame:
    """Each edge takes the lesser of its weights after inhibition among the edges of either end, all at once.

    Only the `most` heaviest edges of a node inhibit others, so that many weights are kept for it, however many edges it has."""
    ends = edges.select("source_id", "target_id", "relation", F.col("weight").cast("double").alias("weight"), F.explode(F.array("source_id", "target_id")).alias("_end"))
    first = ends.select("_end", "weight").withColumn("_k", F.row_number().over(Window.partitionBy("_end").orderBy(F.desc("weight")))).where(F.col("_k") <= most)
    strong = first.groupBy("_end").agg(F.sort_array(F.collect_list("weight"), asc=False).alias("_strong"))
    less = F.aggregate(F.filter("_strong", lambda v: v > F.col("weight")), F.lit(0.0), lambda a, v: a + (v - F.col("weight")))
    w = ends.join(strong, "_end").withColumn("_w", F.greatest(F.lit(0.0), F.col("weight") - beta * less))
    return w.groupBy("source_id", "target_id", "relation").agg(F.min("_w").alias("weight"))


# What a relation says of the fact it points to, in order of precedence.
VALENCE = {"contradicts": "contrasting", "supersedes": "superseded", "qualifies": "qualifying", "supports": "supporting"}


def valence(edges: DataFrame) -> DataFrame:
    """One class per target: of its edges' classes the first in order of precedence, neutral if there is none."""
    ranks = {k: i for i, k in enumerate(VALENCE)}
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("relation")], F.lit(len(ranks)))
    names = F.array(*[F.lit(v) for v in [*VALENCE.values(), "neutral"]])
    return edges.groupBy("target_id").agg(F.min(rank).alias("_r")).select("target_id", F.element_at(names, F.col("_r") + 1).alias("valence"))


def bridges_by_likeness(bits: DataFrame, threshold: float = 0.7, block: int = 4096) -> DataFrame:
    """All pairs a < b of vectors (vec_id, bits) whose sign bits have a Jaccard likeness of at least threshold.

    Equal bit patterns are one class. Any two classes may be alike at such thresholds, so classes are compared in
    pairs of blocks, each a bounded group; blocks whose counts of bits are too far apart are left out."""
    classes = bits.where("bits <> 0").select("bits").distinct().withColumn("ones", F.bit_count("bits"))
    n = classes.count()
    parts = max(1, math.ceil(n / block / 4))
    cells = classes.withColumn("cell", F.col("ones") * parts + F.pmod(F.xxhash64("bits"), F.lit(parts)))
    # Bit counts x <= y can only be alike if x >= threshold y.
    wide = F.sequence(F.lit(1), F.lit(64))
    fits = F.filter(wide, lambda o: F.least(o, "ones") >= threshold * F.greatest(o, "ones"))
    others = F.flatten(F.transform(fits, lambda o: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: o * parts + p)))
    dealt = cells.select("bits", "cell", F.explode(others).alias("o")).select("bits", "cell", F.least("cell", "o").alias("x"), F.greatest("cell", "o").alias("y"))

    def alike(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p["x"].iloc[0], p["y"].iloc[0]
        v = p["bits"].to_numpy().view(np.uint64)
        left, right = v[p["cell"] == x], v[p["cell"] == y]
        out = []
        for i in range(0, len(left), 256):
            part = left[i : i + 256, None]
            both, either = np.bitwise_count(part & right).astype(float), np.bitwise_count(part | right)
            a, b = np.nonzero((both / either >= threshold) & (part != right))
            out.append(pd.DataFrame({"pa": left[i + a].view(np.int64), "pb": right[b].view(np.int64), "jaccard": (both / either)[a, b]}))
        return pd.concat(out) if out else pd.DataFrame({"pa": [], "pb": [], "jaccard": []})

    met = dealt.groupBy("x", "y").applyInPandas(alike, "pa long, pb long, jaccard double")
    met = met.select(F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb"), "jaccard").distinct()
    same = bits.where("bits <> 0").select(F.col("vec_id"), "bits")
    of = lambda k: same.select(F.col("bits").alias(f"p{k}"), F.col("vec_id").alias(k))
    other = met.join(of("a"), "pa").join(of("b"), "pb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    twins = of("a").join(of("b"), F.col("pa") == F.col("pb")).where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    return twins.unionByName(other)
