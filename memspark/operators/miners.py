"""More miners and walks of the graph: causal marks, bridges, communities, traces, likeness of texts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..lineage import cut, shared_folder
from . import filters as fl
from . import graph as gr
from . import joins as jn

# Relations that mean cause.
CAUSAL = ["caused", "led_to", "prevented"]

#: Nodes of a block of which later ones meet earlier ones.
LED_BLOCK = 4096
#: Links of a part of a graph, which one task holds in lists.
LINKS = 1_000_000


def led_to(nodes: DataFrame, marker: str, rare: int | None = None, shortest: int = 300, longest: int = 30 * 86_400) -> DataFrame:
    """nodes (node_id, content, created_at): edges from a node to a later one that marks an outcome of the same topic.

    Both share a word (on at most `rare` nodes, if given), lie between shortest and longest seconds apart, and the
    later one's text matches the marker. Nodes meet in blocks within spans of time, each two of them once, so pairs are never shuffled."""
    rows = nodes.select("node_id", F.col("created_at").cast("long").alias("created_at"), F.coalesce(F.col("content").rlike(marker), F.lit(False)).alias("marked"), tx.tokens(F.col("content"), 4).alias("words")).where("created_at is not null")
    if rare is not None:
        words = rows.select("node_id", "created_at", "marked", F.explode("words").alias("token"))
        few = words.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n").between(2, rare)).select("token")
        rows = words.join(few, "token", "left_semi").groupBy("node_id", "created_at", "marked").agg(F.collect_set("token").alias("words"))
    rows = cut(rows.where("size(words) > 0"))
    span = F.floor(F.col("created_at") / longest)
    early = rows.select("node_id", "created_at", "words", span.alias("_span"))
    late = rows.where("marked").select("node_id", "created_at", "words", F.explode(F.array(span, span - 1)).alias("_span"))
    left, right = jn.in_blocks(early, late, ["_span"], LED_BLOCK)
    cell = ["_span", "_i", "_j"]
    kind = nodes.schema["node_id"].dataType.simpleString()
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(lambda x, y: _led(x, y, shortest, longest), f"target_id {kind}, sources array<{kind}>")
    near = met.select(F.explode("sources").alias("source_id"), "target_id")
    # Only nodes that repeat give a pair twice.
    if not rows.groupBy("node_id").count().where("count > 1").isEmpty():
        near = near.distinct()
    return near.select("source_id", "target_id", F.lit("led_to").alias("relation"), F.lit(0.3).alias("weight"))


def _led(early: pa.Table, late: pa.Table, shortest: int, longest: int) -> pa.Table:
    """Of each later node the earlier ones that share a word with it and lie between shortest and longest seconds before it."""
    kind = pa.schema([("target_id", late["node_id"].type), ("sources", pa.list_(early["node_id"].type))])
    if not len(early) or not len(late):
        return kind.empty_table()
    lists = late["words"].combine_chunks()
    names = lists.flatten().unique()
    bits = jn.bitmaps(early["words"].combine_chunks(), names)
    at, ends = pc.index_in(lists.flatten(), value_set=names).to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
    was, is_, ids = early["created_at"].to_numpy(), late["created_at"].to_numpy(), early["node_id"].combine_chunks()
    found, sizes = [], []
    for k, end in enumerate(ends.tolist()):
        shared = np.unpackbits(np.bitwise_or.reduce(bits[at[ends[k - 1] if k else 0 : end]]), count=len(early)).view(bool)
        apart = is_[k] - was
        found.append(np.flatnonzero(shared & (apart >= shortest) & (apart <= longest)))
        sizes.append(len(found[-1]))
    sources = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), ids.take(pa.array(np.concatenate(found))))
    out = pa.table({"target_id": late["node_id"].combine_chunks(), "sources": sources}).filter(pa.array(np.array(sizes) > 0))
    return pa.Table.from_batches(out.cast(kind).to_batches(max_chunksize=jn.ROWS), kind)


def bridges(nodes: DataFrame, edges: DataFrame, threshold: float = 0.7, scale: float = 0.3) -> DataFrame:
    """Each isolated node with the most alike other node (the least of them): weight = likeness x scale, from `threshold` on.

    Exact without all pairs: nodes of equal word sets are one class, whose members are alike by 1. Two classes as
    alike as the threshold share one of the rarest words of each (the first n - ceil(threshold n) + 1 of n, rarest
    first), so only those are joined. Nodes without words have no bridge."""
    sets = nodes.where(fl.not_hub()).select("node_id", F.array_sort(tx.tokens(F.col("content"))).alias("words")).where("size(words) > 0").withColumn("class", F.array_join("words", " "))
    low = sets.groupBy("class").agg(F.min("node_id").alias("low"), F.count("*").alias("n"))
    second = sets.join(low.where("n > 1"), "class").where("node_id <> low").groupBy("class").agg(F.min("node_id").alias("second"))
    lone = sets.join(gr.isolated(nodes, edges), "node_id", "left_semi").select("node_id", "class").join(low, "class").join(second, "class", "left")
    twins = lone.where("n > 1").select(F.col("node_id").alias("a"), F.when(F.col("node_id") == F.col("low"), F.col("second")).otherwise(F.col("low")).alias("b"), F.lit(1.0).alias("likeness"))
    single = lone.where("n = 1").select(F.col("node_id").alias("a"), "class")
    words = sets.select("class", "words").distinct().select("class", F.size("words").alias("n"), F.explode("words").alias("word"))
    seen = words.groupBy("word").agg(F.count("*").alias("df"))
    rank = Window.partitionBy("class").orderBy("df", "word")
    first = words.join(seen, "word").withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("class", "word")
    met = first.join(single, "class").select("a", F.col("class").alias("ca"), "word").join(first.select(F.col("class").alias("cb"), "word"), "word").where("ca <> cb").select("a", "ca", "cb").distinct()
    alike = met.withColumn("likeness", tx.jaccard(F.split("ca", " "), F.split("cb", " "))).where(F.col("likeness") >= threshold)
    others = alike.join(low.select(F.col("class").alias("cb"), F.col("low").alias("b")), "cb").groupBy("a").agg(F.min_by(F.struct("b", "likeness"), F.struct((-F.col("likeness")).alias("l"), "b")).alias("_f")).select("a", "_f.b", "_f.likeness")
    best = twins.unionByName(others)
    return best.select(F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"), F.lit("dream_bridge").alias("relation"), (F.col("likeness") * scale).alias("weight")).distinct()


def communities(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node and community by label propagation: each node takes the label with the most weight among its neighbours and
    itself (its own counts once its heaviest edge), the least label on ties. All nodes move at once, so the result doesn't
    depend on how rows are dealt out.

    Without `rounds` it goes on until the labels settle: none changes, or all are those of two rounds before (then the lesser
    of the two is taken). Votes are whole millionths and ties go to the least label, so one of both comes. Nodes become their
    places in the order of names and links are dealt once, as lists of numbers; rounds read labels from the shared folder (four bytes
    a node in a task) and shuffle nothing."""
    folder = f"{shared_folder(edges.sparkSession).rstrip('/')}/communities-{uuid.uuid4().hex}"
    kept = _kept(edges.select("source_id", "target_id", F.round(F.coalesce(F.col("weight"), F.lit(0.0)) * 1e6).cast("long").alias("weight")).where("source_id is not null and target_id is not null"), f"{folder}/edges")
    rows, ids = 2 * kept.count(), jn.numbered(kept.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct().sort("node"), "_id")
    n = ids.count()
    of = lambda end, k: ids.select(F.col("node").alias(end), F.col("_id").alias(k))
    ends = kept.join(of("source_id", "a"), "source_id").join(of("target_id", "b"), "target_id").select("a", "b", "weight")
    both = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("node"), F.col("a").alias("neighbour")))).alias("_e"), "weight").select("_e.*", "weight")
    parts = max(1, math.ceil(rows / LINKS))
    dealt = both.withColumn("_p", F.pmod("node", F.lit(parts))).groupBy("_p").applyInArrow(_adjacent, "node int, neighbours array<int>, weights array<long>")
    links = _kept(dealt, f"{folder}/links")
    k, settled = 0, rows == 0 or rounds == 0
    while not settled:
        k += 1
        at = [f"{folder}/labels-{i}" if i > 0 else None for i in (k - 1, k - 2)]
        now = _kept(links.mapInArrow(lambda batches, at=at: _voted(batches, n, *at), "node int, community int, was int, earlier int"), f"{folder}/labels-{k}")
        if rounds is None:
            stays, back = now.agg(F.bool_and(F.col("community") == F.col("was")), F.bool_and(F.col("community") == F.col("earlier"))).first()
            settled = stays or (back and k > 1)
        else:
            settled = k == rounds
    label = F.least("community", "was") if rounds is None else F.col("community")
    labels = now.select(F.col("node").alias("_id"), label.alias("_c")) if k else ids.select("_id", F.col("_id").alias("_c"))
    named = jn.in_tasks(labels, n, "_id").join(jn.in_tasks(ids, n, "_id"), "_id").select("node", "_c")
    return jn.in_tasks(named, n, "_c").join(jn.in_tasks(ids.select(F.col("_id").alias("_c"), F.col("node").alias("community")), n, "_c"), "_c").select("node", "community")


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df, written once in columns, which take a fraction of a checkpoint's rows."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _adjacent(t: pa.Table) -> pa.Table:
    """Each node's neighbours with the heaviest of their weights; itself with the heaviest of all."""
    node, other, weight = (t[c].to_numpy() for c in ("node", "neighbour", "weight"))
    order = np.lexsort((-weight, other, node))
    node, other, weight = node[order], other[order], weight[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    own, most = node[starts], np.maximum.reduceat(weight, starts)
    first = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])] & (node != other)
    node, other, weight = np.r_[node[first], own], np.r_[other[first], own], np.r_[weight[first], most]
    order = np.argsort(node, kind="stable")
    ends = pa.array(np.r_[0, np.cumsum(np.bincount(np.searchsorted(own, node), minlength=len(own)))], pa.int32())
    return pa.table({"node": own, "neighbours": pa.ListArray.from_arrays(ends, pa.array(other[order])), "weights": pa.ListArray.from_arrays(ends, pa.array(weight[order]))})


_labels: dict[str, np.ndarray] = {}


def _label_of(path: str | None, n: int) -> np.ndarray:
    """The label of each node after a round (at first its own); a worker keeps those of the last two rounds it read."""
    if path is None:
        return np.arange(n, dtype=np.int32)
    if path not in _labels:
        system, root = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        out = np.zeros(n, np.int32)
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.path.endswith(".parquet"):
                t = pq.read_table(system.open_input_file(f.path), columns=["node", "community"])
                out[t["node"].to_numpy()] = t["community"].to_numpy()
        for old in list(_labels)[:-1]:
            del _labels[old]
        _labels[path] = out
    return _labels[path]


def _voted(batches: Iterator[pa.RecordBatch], n: int, last: str | None, before: str | None) -> Iterator[pa.RecordBatch]:
    """Each node's next label, its last one and the one before."""
    label, earlier = _label_of(last, n), _label_of(before, n)
    for batch in batches:
        size = pc.list_value_length(batch["neighbours"]).to_numpy().astype(np.int64)
        # A batch is worked in runs of rows, so what sorting takes doesn't follow the nodes' numbers of neighbours.
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // LINKS)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            part = batch.slice(low, high - low)
            if not len(part):
                continue
            voter, weight = label[part["neighbours"].flatten().to_numpy()], part["weights"].flatten().to_numpy()
            owner = np.repeat(np.arange(len(part)), size[low:high])
            order = np.argsort(owner * n + voter, kind="stable")
            voter, owner = voter[order], owner[order]
            starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (voter[1:] != voter[:-1])])
            votes, owner, voter = np.add.reduceat(weight[order], starts), owner[starts], voter[starts]
            best = np.lexsort((voter, -votes, owner))
            best = best[np.r_[True, owner[1:] != owner[:-1]]]
            node = part["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (node, voter[best], label[node], earlier[node])], ["node", "community", "was", "earlier"])


def trace(edges: DataFrame, roots: DataFrame, depth: int = 5, relations: list[str] | None = None) -> DataFrame:
    """roots (node): root, node, relation, weight and depth of all that follows from each root over causal edges.

    A node is reported where it is met first, over its heaviest edge; loops end there."""
    causal = edges.where(F.col("relation").isin(CAUSAL if relations is None else relations)).select("source_id", "target_id", "relation", "weight")
    front = roots.select(F.col("node").alias("root"), "node", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("weight"), F.lit(0).alias("depth"))
    seen = front
    for k in range(1, depth + 1):
        step = front.select("root", F.col("node").alias("source_id")).join(causal, "source_id").groupBy("root", F.col("target_id").alias("node"))
        best = step.agg(F.max_by(F.struct("relation", "weight"), F.struct("weight", "relation")).alias("_e"))
        front = best.select("root", "node", "_e.relation", F.col("_e.weight").cast("double").alias("weight"), F.lit(k).alias("depth")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def old_anchors(nodes: DataFrame, edges: DataFrame, now: int, kind: str = "anchor", days: int = 7) -> DataFrame:
    """Anchor nodes without an edge, older than `days`."""
    return gr.isolated(nodes.where(F.col("node_type") == kind), edges).where(F.col("created_at") < now - days * 86_400)


def mermaid(nodes: DataFrame, edges: DataFrame, limit: int = 50, most: int = 60) -> DataFrame:
    """One row, text: a Mermaid drawing of the first `limit` nodes and the edges among them."""
    chosen = nodes.orderBy("node_id").limit(limit)
    label = F.trim(F.translate(F.concat(F.substring("content", 1, most), F.lit(" ("), "node_type", F.lit(")")), '"\n', "' "))
    boxes = chosen.select(F.lit(0).alias("part"), F.col("node_id").alias("k"), F.lit("").alias("k2"), F.concat(F.lit("  "), "node_id", F.lit('["'), label, F.lit('"]')).alias("line"))
    ids = chosen.select("node_id")
    inside = edges.join(F.broadcast(ids.withColumnRenamed("node_id", "source_id")), "source_id", "left_semi").join(F.broadcast(ids.withColumnRenamed("node_id", "target_id")), "target_id", "left_semi")
    arrows = inside.select(F.lit(1).alias("part"), F.col("source_id").alias("k"), F.col("target_id").alias("k2"), F.concat(F.lit("  "), "source_id", F.lit(" -->|"), "relation", F.lit("| "), "target_id").alias("line"))
    lines = F.sort_array(F.collect_list(F.struct("part", "k", "k2", "line")))
    return boxes.unionByName(arrows).agg(F.concat_ws("\n", F.lit("graph TD"), F.transform(lines, lambda x: x["line"])).alias("text"))


def bm25_pair(a: Column, b: Column, k1: float = 1.5, share: float = 0.75) -> Column:
    """Likeness of two texts, in 0..1: BM25 of the words they share, in a collection of just the two."""
    wa, wb = F.filter(F.split(F.lower(a), "\\s+"), lambda w: w != ""), F.filter(F.split(F.lower(b), "\\s+"), lambda w: w != "")
    mean = F.greatest((F.size(wa) + F.size(wb)) / 2, F.lit(1.0))
    part = lambda words, w: (lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - share + share * F.size(words) / mean)))(F.size(F.filter(words, lambda x: x == w)))
    total = F.aggregate(F.array_intersect(wa, wb), F.lit(0.0), lambda s, w: s + (part(wa, w) + part(wb, w)) / 2)
    return F.least(F.lit(1.0), total * F.log(F.lit(2.0)) / (F.log(F.lit(3.0)) + 1))


def similarity(a: Column, b: Column) -> Column:
    """Short texts by their character n-grams, longer ones more and more by their words; empty ones are like nothing."""
    size = F.greatest(F.length(a), F.length(b))
    grams = (tx.jaccard(_grams(a, 3), _grams(b, 3)) + tx.jaccard(_grams(a, 4), _grams(b, 4))) / 2
    words = bm25_pair(a, b)
    mixed = F.when(size < 80, grams).when(size < 400, 0.4 * words + 0.6 * grams).otherwise(0.6 * words + 0.4 * grams)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), mixed).otherwise(0.0)


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; shorter texts have none."""
    return F.when(F.length(text) >= n, tx.char_ngrams(text, n)).otherwise(F.array().cast("array<string>"))


def twins(rows: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """rows (keys, id, content): pairs a < b of equal keys whose likeness is over `least`, with their similarity.

    Texts are compared once for all rows that have them; rows are paired only where their texts are alike."""
    texts = rows.select(*keys, "content").distinct()
    of = lambda df, k: df.select(*keys, F.col("content").alias(f"t{k}"), *[F.col(c).alias(k) for c in df.columns if c == "id"])
    alike = of(texts, "a").join(of(texts, "b"), keys).withColumn("similarity", similarity(F.col("ta"), F.col("tb"))).where(F.col("similarity") > least)
    return alike.join(of(rows, "a"), [*keys, "ta"]).join(of(rows, "b"), [*keys, "tb"]).where("a < b").select(*keys, "a", "b", "similarity")


def conflicts(saves: DataFrame, facts: DataFrame, keys: list[str], least: float = 0.3, most: int = 5) -> DataFrame:
    """saves (keys, save_id, content) against facts (keys, entry_id, content): the first fact that contradicts each save.

    Candidates share one of the save's first five words of over three characters; of those the `most` with the
    smallest entry_id are compared, and the first whose likeness is over `least` and whose text differs conflicts.
    They are among the `most` smallest of each word, so no more of a word are joined."""
    long_words = lambda c: F.filter(F.split(F.lower(c), "\\s+"), lambda w: F.length(w) > 3)
    asked = saves.select(*keys, "save_id", F.explode(F.array_distinct(F.slice(long_words(F.col("content")), 1, 5))).alias("_word"))
    held = facts.select(*keys, "entry_id", F.explode(F.array_distinct(long_words(F.col("content")))).alias("_word")).distinct()
    held = held.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_word").orderBy("entry_id"))).where(F.col("_n") <= most).drop("_n")
    met = asked.join(held, [*keys, "_word"]).select(*keys, "save_id", "entry_id").distinct()
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "save_id").orderBy("entry_id"))).where(F.col("_n") <= most)
    both = met.join(saves.select(*keys, "save_id", F.col("content").alias("_new")), [*keys, "save_id"]).join(facts.select(*keys, "entry_id", F.col("content").alias("_old")), [*keys, "entry_id"])
    found = both.withColumn("similarity", similarity(F.col("_new"), F.col("_old"))).where((F.col("similarity") > least) & (F.col("_new") != F.col("_old")))
    return found.groupBy(*keys, "save_id").agg(F.min_by(F.struct("entry_id", "similarity"), "_n").alias("_f")).select(*keys, "save_id", "_f.entry_id", "_f.similarity")
