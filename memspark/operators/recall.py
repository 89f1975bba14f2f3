"""Recall from several sources, expansion over the graph, routing and supersession.

Hits have the columns query_id, source, native_id, content, score and created_at; all queries share one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..functions.policy import kind_weight
from . import filters as fl
from . import joins as jn
from . import matching as mt
from . import windows as wn

# How much an intent lifts or lowers a source; what a hit by a synonym counts; what a superseded name leaves.
INTENTS = {"recent": {"episodic": 1.5, "rag": 1.2, "core": 0.8}, "core": {"core": 1.5, "wiki": 1.2, "episodic": 0.8}, "balanced": {}}
ENTITY_SCORE, COUNTER_FACTOR, LEAST_CONFIDENCE, LEAST_ACTIVATION = 0.45, 0.7, 0.3, 0.12
HIT = ["query_id", "source", "native_id", "content", "score", "created_at"]


def weight_of(intent: str, source: str) -> float:
    return INTENTS[intent].get(source, 1.0)


def _hits(rows: DataFrame, asked: DataFrame, ident: str, hay: Column) -> DataFrame:
    """query_id and ident of the rows whose text holds a word of a query. asked: query_id, pattern. Texts pass one automaton."""
    narrow = rows.select(ident, F.lower(hay).alias("_hay"))
    return mt.occurrences(narrow, [ident], "_hay", asked).select(ident, "pattern").join(asked, "pattern").select("query_id", ident).distinct()


def _words(queries: DataFrame, words: Column) -> DataFrame:
    return queries.select("query_id", F.explode(words).alias("pattern")).distinct()


def _found(rows: DataFrame, queries: DataFrame, ident: str, hay: Column, least: int = 3) -> DataFrame:
    words = F.filter(F.split(F.lower("query"), " "), lambda w: F.length(w) >= least)
    return _hits(rows, _words(queries, words), ident, hay).join(rows, ident)


def _lifted(found: DataFrame, active: Column) -> DataFrame:
    """found with _lift: the activation scaled to 1.0 to 1.3 among a query's hits, whose bounds are pre-aggregated and go to every task: a query's hits never meet in one."""
    rows = found.withColumn("_a", active)
    bounds = rows.groupBy("query_id").agg(F.min("_a").alias("_low"), F.max("_a").alias("_high"))
    span = F.col("_high") - F.col("_low")
    return rows.join(F.broadcast(bounds), "query_id").withColumn("_lift", F.when(span < 1e-12, 1.0).otherwise(1.0 + 0.3 * (F.col("_a") - F.col("_low")) / span)).drop("_a", "_low", "_high")


def core_source(facts: DataFrame, queries: DataFrame, uses: DataFrame, now: int, intent: str = "balanced") -> DataFrame:
    """Facts (entry_id, key, value, importance, memory_kind, created_at) with a word of the query: importance x intent x
    kind x use. uses (entry_id, n, last_ts) counts how often each was of use; the activation this gives is scaled to
    1.0..1.3 among a query's hits."""
    found = _found(facts, queries, "entry_id", F.concat_ws(" ", "key", "value")).join(uses, "entry_id", "left")
    found = _lifted(found, sc.actr(F.lit(now), F.coalesce("last_ts", "created_at"), F.coalesce("n", F.lit(0))))
    score = F.col("importance") * weight_of(intent, "core") * kind_weight(F.col("memory_kind")) * F.col("_lift")
    return found.select("query_id", F.lit("core").alias("source"), F.col("entry_id").alias("native_id"), F.col("value").alias("content"), score.alias("score"), "created_at")


def episode_source(episodes: DataFrame, queries: DataFrame, now: int, intent: str = "balanced") -> DataFrame:
    """Episodes (episode_id, summary, weight, created_at) with a word of the query: weight x intent x recency of one use."""
    found = _lifted(_found(episodes, queries, "episode_id", F.col("summary")), sc.actr(F.lit(now), F.col("created_at"), F.lit(1)))
    return found.select("query_id", F.lit("episodic").alias("source"), F.col("episode_id").alias("native_id"), F.col("summary").alias("content"), (F.col("weight") * weight_of(intent, "episodic") * F.col("_lift")).alias("score"), "created_at")


def graph_source(nodes: DataFrame, queries: DataFrame, intent: str = "balanced") -> DataFrame:
    """Nodes (node_id, content, confidence, created_at) that hold the whole query."""
    met = _hits(nodes, _words(queries, F.array(F.lower("query"))), "node_id", F.col("content")).join(nodes, "node_id")
    return met.select("query_id", F.lit("graph").alias("source"), F.col("node_id").alias("native_id"), "content", (F.col("confidence") * weight_of(intent, "graph")).alias("score"), "created_at")


def entity_source(nodes: DataFrame, queries: DataFrame, synonyms: Mapping[str, Sequence[str]], intent: str = "balanced") -> DataFrame:
    """Nodes that hold any member of a synonym class of the query's words of four letters or more; a fixed low score."""
    known = set(synonyms) | {v for vs in synonyms.values() for v in vs}
    members = {w: sorted({w, *synonyms.get(w, []), *(k for k, vs in synonyms.items() if w in vs)}) for w in known if len(w) >= 4}
    if not members:
        return graph_source(nodes, queries).limit(0)
    table = F.create_map(*[x for k, v in members.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = F.array_distinct(F.flatten(F.filter(F.transform(tx.tokens(F.col("query"), 4), lambda w: table[w]), lambda v: v.isNotNull())))
    met = _hits(nodes, _words(queries, words), "node_id", F.col("content")).join(nodes, "node_id")
    return met.select("query_id", F.lit("entities").alias("source"), F.col("node_id").alias("native_id"), "content", F.lit(ENTITY_SCORE * weight_of(intent, "entities")).alias("score"), "created_at")


def text_source(rows: DataFrame, name: str, scores: DataFrame, ident: str, content: str, created_at: Column, intent: str = "balanced") -> DataFrame:
    """Documents or pages by a text score (query_id, ident, score)."""
    return rows.join(scores, ident).select("query_id", F.lit(name).alias("source"), F.col(ident).alias("native_id"), F.col(content).alias("content"), (F.col("score") * weight_of(intent, name)).alias("score"), created_at.alias("created_at"))


def multi_source(sources: Sequence[DataFrame], now: int, limit: int = 10) -> DataFrame:
    """The best 2 x limit hits of each source; of equal contents (first 200 characters) the first by source and rank; scores
    scaled within each source and lifted by recency; then the best `limit` of each query with their place."""
    pool = None
    for s in sources:
        cut = s.select("query_id", "source", F.col("native_id").cast("string").alias("native_id"), "content", F.col("score").cast("double").alias("score"), F.col("created_at").cast("long").alias("created_at"))
        best = wn.newest(cut, ["query_id"], 2 * limit, F.desc(F.round("score", 6)), F.asc("native_id"))
        pool = best if pool is None else pool.unionByName(best)
    seen = Window.partitionBy("query_id", F.substring("content", 1, 200)).orderBy("source", F.desc(F.round("score", 6)), "native_id")
    once = pool.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")
    return wn.merge_ranked(once, now, ["query_id"], limit)


def graph_expansion(hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours of the hits that are nodes, that aren't hits themselves: half the edge's weight x confidence, the best of each."""
    start = hits.where("source = 'graph'").select("query_id", F.col("native_id").alias("node"))
    near = start.join(jn.both_ways(edges, "weight"), "node").join(nodes.select(F.col("node_id").alias("neighbour"), "content", "confidence", "created_at"), "neighbour")
    there = hits.select("query_id", F.col("native_id").alias("neighbour")).distinct()
    best = near.join(there, ["query_id", "neighbour"], "left_anti").groupBy("query_id", "neighbour").agg(F.max(0.5 * F.col("weight") * F.col("confidence")).alias("score"), F.first("content").alias("content"), F.first("created_at").alias("created_at"))
    return best.select("query_id", F.lit("graph_expand").alias("source"), F.col("neighbour").alias("native_id"), "content", "score", "created_at")


def led_to_neighbours(edges: DataFrame, start: DataFrame, now: int) -> DataFrame:
    """start (node): the nodes joined to each by active led_to edges, either way."""
    live = edges.where((F.col("relation") == "led_to") & fl.active(now))
    return start.join(jn.both_ways(live), "node").groupBy("node").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))


def counter_signals(hits: DataFrame, queries: DataFrame, renamed: Mapping[str, str]) -> DataFrame:
    """Scores of hits that use a superseded name and not the current one, unless the query asks for the old one: x 0.7 for each."""
    both = hits.join(F.broadcast(queries.select("query_id", "query")), "query_id")
    low, asks, factor = F.lower("content"), F.lower("query"), F.lit(1.0)
    for old, new in renamed.items():
        factor = factor * F.when(F.contains(low, F.lit(old)) & ~F.contains(low, F.lit(new)) & ~F.contains(asks, F.lit(old)), COUNTER_FACTOR).otherwise(1.0)
    return both.withColumn("score", F.col("score") * factor).drop("query")


def field_boost(hits: DataFrame, queries: DataFrame, fields: DataFrame, weight: float = 0.1) -> DataFrame:
    """fields (native_id, words): questions that a row answers. + weight for each word that query and field share."""
    met = hits.join(F.broadcast(queries.select("query_id", tx.tokens(F.col("query")).alias("_q"))), "query_id").join(fields, "native_id", "left")
    shared = F.size(F.array_intersect("_q", F.coalesce("words", F.array().cast("array<string>"))))
    return met.withColumn("score", F.col("score") + weight * shared).drop("_q", "words")


def exhaustive(nodes: DataFrame, queries: DataFrame, least: int = 2) -> DataFrame:
    """All nodes of the category that an enumerating query names (the word after its mark); categories of under `least`
    members give nothing. queries: enumerative ones."""
    mark = "(?:все(?:\\s+|х)|список\\s+(?:все\\S*\\s+)?|list\\s+all\\s+|перечисл\\S*\\s+(?:все\\S*\\s+)?)([\\pL\\pN_]+)"
    asked = queries.select("query_id", F.regexp_extract(F.lower("query"), mark, 1).alias("node_type")).where("node_type <> ''")
    met = nodes.join(F.broadcast(asked), "node_type")
    # Members are counted in place and the queries left go to every task: a category never meets in one.
    enough = met.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("query_id")
    return met.join(F.broadcast(enough), "query_id", "left_semi").select("query_id", F.lit("s2_exhaustive").alias("source"), F.col("node_id").alias("native_id"), "content", F.col("confidence").alias("score"), "created_at")


def routed(queries: DataFrame, nodes: DataFrame, dense: DataFrame, second: DataFrame, renamed: Mapping[str, str], limit: int = 10) -> DataFrame:
    """One answer for each query by its class: enumerative ones get their whole category; the others the dense hits, and
    multi-hop ones whose hits cover under 0.3 of their words the second pass's, too, less what is there. Queries whose
    best hit is under 0.12 get nothing. Superseded names count less at the end.

    dense, second: hits with scores in 0..1, made for all queries. Adds route and place."""
    classed = queries.withColumn("route", tx.classify_query(F.col("query")))
    whole = exhaustive(nodes, classed.where("route = 'enumerative'")).select(*HIT).withColumn("native_id", F.col("native_id").cast("string"))
    answered = whole.select("query_id").distinct()
    left = classed.join(answered, "query_id", "left_anti")
    first = dense.join(left.select("query_id"), "query_id", "left_semi").select(*HIT)
    words = tx.tokens(F.col("query"))
    seen = first.join(left.select("query_id", words.alias("_q")), "query_id").groupBy("query_id").agg(F.first("_q").alias("_q"), F.array_distinct(F.flatten(F.collect_list(F.array_intersect(tx.tokens(F.col("content")), "_q")))).alias("_s"))
    sure = seen.select("query_id", (F.size("_s") / F.greatest(F.size("_q"), F.lit(1))).alias("confidence"))
    unsure = left.where("route = 'multi_hop'").join(sure, "query_id", "left").where(F.coalesce("confidence", F.lit(0.0)) < LEAST_CONFIDENCE).select("query_id")
    more = second.join(unsure, "query_id", "left_semi").join(first.select("query_id", "source", "native_id"), ["query_id", "source", "native_id"], "left_anti").select(*HIT)
    both = first.withColumn("_pass", F.lit(0)).unionByName(more.withColumn("_pass", F.lit(1)))
    top = F.max("score").over(Window.partitionBy("query_id"))
    kept = both.withColumn("_top", top).where(F.col("_top") >= LEAST_ACTIVATION).drop("_top").unionByName(whole.withColumn("_pass", F.lit(0)))
    placed = counter_signals(kept, queries, renamed)
    w = Window.partitionBy("query_id").orderBy("_pass", F.desc(F.round("score", 6)), "source", "native_id")
    return placed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).join(F.broadcast(classed.select("query_id", "route")), "query_id").drop("_pass")


def current_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """facts (keys, key, entry_id, scope, contradicts) with is_current: an earlier side is superseded where its pair's later
    side is there: under the key it names with ::vN after it, or under that key itself with scope later."""
    base = F.regexp_replace("key", "::v.*$", "")
    later = facts.where((F.col("scope") == "later") | F.contains("key", F.lit("::v"))).select(*keys, base.alias("_ref")).distinct().withColumn("_later", F.lit(True))
    ref = F.coalesce("contradicts", "key")
    met = facts.withColumn("_ref", ref).join(later, [*keys, "_ref"], "left")
    return met.withColumn("is_current", ~(F.coalesce(F.col("scope") == "earlier", F.lit(False)) & F.coalesce("_later", F.lit(False)))).drop("_ref", "_later")


def per_kind(facts: DataFrame, kinds: Sequence[str], limit: int) -> DataFrame:
    """The most important `limit` facts of each kind asked for."""
    return wn.newest(facts.where(F.col("memory_kind").isin(*kinds)), ["memory_kind"], limit, F.desc(F.round("importance", 6)), F.asc("entry_id"))


def in_order(parts: Sequence[DataFrame], keys: list[str], limit: int, order: Sequence[str]) -> DataFrame:
    """The parts one after the other (facts before episodes), cut to `limit` for each key."""
    pool = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        pool = p if pool is None else pool.unionByName(p)
    return pool.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("part", *[F.asc(o) for o in order]))).where(F.col("place") <= limit)


def link_reach(links: DataFrame, start: DataFrame, depth: int = 2, direction: str = "out", link_type: str | None = None) -> DataFrame:
    """links (from_path, to_path, link_type), start (path): origin, path and least depth of all that is reached in 1 to 5 hops."""
    depth = max(1, min(depth, 5))
    used = links if link_type is None else links.where(F.col("link_type") == link_type)
    ahead, back = used.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")), used.select(F.col("to_path").alias("a"), F.col("from_path").alias("b"))
    step = {"out": ahead, "in": back, "both": ahead.unionByName(back)}[direction].distinct()
    front = start.select(F.col("path").alias("origin"), "path", F.lit(0).alias("depth"))
    seen = front
    for k in range(1, depth + 1):
        found = front.join(step, front["path"] == step["a"]).select("origin", F.col("b").alias("path"), F.lit(k).alias("depth")).distinct()
        front = found.join(seen.select("origin", "path"), ["origin", "path"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def relations_to_depth(links: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """All walks of up to `depth` links from each start (origin, path, depth), one row each; walks aren't made distinct."""
    front = start.select(F.col("path").alias("origin"), "path")
    out = None
    for k in range(1, depth + 1):
        front = front.join(links, front["path"] == links["from_path"]).select("origin", F.col("to_path").alias("path"))
        here = front.withColumn("depth", F.lit(k))
        out = here if out is None else out.unionByName(here)
    return out
