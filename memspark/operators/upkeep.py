"""The stores' upkeep: bins and restores, forgetting, promotion, re-dating, twins, versions, projects and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins as jn
from . import windows as wn

DAY = 86_400
#: Tasks that the rows of one value are dealt to.
DEALT = 16
#: Parts of the lists of a value's pages and facts; pages and facts of a list.
PARTS, PAGES, FACTS = 64, 8, 4096
#: Facts and rows of a block that are compared.
EVIDENCE_BLOCK = 16_384


# -- facts --------------------------------------------------------------------------------


def save_facts(current: DataFrame, saves: DataFrame, kinds: DataFrame, keys: list[str], ttl_days: int = 30) -> dict[str, DataFrame]:
    """current and saves: keys, value, importance, memory_kind, expires_at, visibility, at; saves may leave all but keys, value
    and at null. What is left out takes the kind's default importance, `ttl_days` for kinds that need an expiry, and the
    visibility of the row replaced. Of saves of one key the latest counts as the new row (at one time: by value, importance, kind, expiry, visibility), each is a change.

    Returns facts (the next version), history (old and new value of each change) and intervals (closed where the next opens)."""
    s = saves.withColumn("memory_kind", F.coalesce("memory_kind", F.lit("fact"))).join(kinds, "memory_kind", "left")
    s = s.withColumn("importance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("importance", "default_importance", F.lit(0.5)))))
    s = s.withColumn("expires_at", F.coalesce("expires_at", F.when(F.col("needs_expiry"), F.col("at") + ttl_days * DAY))).select(*current.columns)
    both = current.withColumn("_new", F.lit(0)).unionByName(s.withColumn("_new", F.lit(1)))
    # A total order, so that saves of one time follow each other alike whatever the partitions.
    w = Window.partitionBy(*keys).orderBy("at", "_new", "value", "importance", "memory_kind", "expires_at", "visibility")
    chain = both.withColumn("visibility", F.last("visibility", ignorenulls=True).over(w)).withColumn("visibility", F.coalesce("visibility", F.lit("visible")))
    chain = chain.withColumn("old_value", F.lag("value").over(w)).withColumn("valid_to", F.lead("at").over(w))
    history = chain.where("_new = 1").select(*keys, "old_value", F.col("value").alias("new_value"), "at", F.when(F.col("old_value").isNull(), "created").otherwise("updated").alias("change"))
    return {"facts": chain.where("valid_to is null").select(*current.columns), "history": history, "intervals": chain.select(*keys, "value", F.col("at").alias("valid_from"), "valid_to")}


def delete_facts(facts: DataFrame, gone: DataFrame, keys: list[str], now: int) -> dict[str, DataFrame]:
    """facts (keys, value, at) without the keys in gone; their ledger rows and the intervals that close now."""
    out = facts.join(gone.select(*keys).distinct(), keys, "left_semi")
    return {"facts": facts.join(gone.select(*keys).distinct(), keys, "left_anti"), "history": out.select(*keys, F.col("value").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.lit(now).alias("at")), "intervals": out.select(*keys, F.col("at").alias("valid_from"), F.lit(now).alias("valid_to"))}


def rolled_back(facts: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """facts (keys, value) with the ledger rows given (keys, old_value) undone: their old value, or no row where there was none."""
    met = facts.join(ledger.select(*keys, "old_value", F.lit(True).alias("_hit")), keys, "full")
    return met.where(F.col("_hit").isNull() | F.col("old_value").isNotNull()).select(*keys, F.when(F.col("_hit"), F.col("old_value")).otherwise(F.col("value")).alias("value"))


def split_by_condition(facts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Versions of a key kept side by side: all but the last are earlier, the last is later and named key::vN; both x 0.9."""
    w = Window.partitionBy(*keys)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    f = facts.withColumn("_n", n).withColumn("_k", k)
    several, last = F.col("_n") > 1, F.col("_k") == F.col("_n")
    f = f.withColumn("scope", F.when(several, F.when(last, "later").otherwise("earlier")))
    f = f.withColumn("importance", F.when(several, 0.9 * F.col("importance")).otherwise(F.col("importance")))
    return f.withColumn("versioned_key", F.when(several & last, F.concat(F.col(keys[-1]), F.lit("::v"), F.col("_n").cast("string"))).otherwise(F.col(keys[-1]))).drop("_n", "_k")


def resolved(groups: DataFrame, keep: DataFrame) -> DataFrame:
    """groups (group_id, entry_id), keep (group_id, entry_id): the rows that lose their conflict."""
    decided = keep.select("group_id", F.col("entry_id").alias("_kept"))
    return groups.join(decided, "group_id").where(F.col("entry_id") != F.col("_kept")).drop("_kept")


def bin_rows(archivable: DataFrame, now: int, days: int = 90) -> DataFrame:
    """What goes to the bin for rows that can be archived, with the reason."""
    reason = F.when(F.col("expires_at") < now, "expired").otherwise(f"inactive_{days}d")
    return archivable.select("entry_id", "user_id", "key", "value", reason.alias("archive_reason"), F.lit(now).alias("archived_at"))


def restorable(bin_: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """bin (keys, original_id, memory_type, archive_reason) with refusal: purged rows, rows of unknown types, ids that name
    more than one row, and keys that are taken stay in the bin; null: it can be restored."""
    same = F.count("*").over(Window.partitionBy("original_id"))
    taken = facts.select(*keys, F.lit(True).alias("_taken")).distinct()
    met = bin_.withColumn("_same", same).join(taken, keys, "left")
    why = F.when(F.col("_same") > 1, "ambiguous").when(F.col("archive_reason").startswith("purge"), "purged").when(~F.col("memory_type").isin("core_memory", "episodes"), "unroutable").when((F.col("memory_type") == "core_memory") & F.col("_taken"), "already_present")
    return met.withColumn("refusal", why).drop("_same", "_taken")


def forgotten(facts: DataFrame, scope: str, *, key: str = "", since: int = 0, ids: Sequence[int] = ()) -> DataFrame:
    """What a call to forget would take, and nothing else (its dry run): an exact key, a part of key or value, what came since, or ids."""
    if scope == "exact":
        return facts.where(F.col("key") == key)
    if scope == "fuzzy":
        return facts.where(F.contains(F.lower(F.concat_ws("\n", "key", "value")), F.lit(key.lower()))) if key else facts.limit(0)
    if scope == "recent":
        return facts.where(F.col("created_at") > since)
    if scope == "ids":
        return facts.where(F.col("entry_id").isin(*ids)) if ids else facts.limit(0)
    raise ValueError(f"unknown scope {scope}")


def rescored(facts: DataFrame, uses: DataFrame, score: Column, curated: Sequence[str], now: int, days: int = 30, least: float = 0.15) -> DataFrame:
    """Facts of the last `days` whose score (an expression that may use n, how often they were of use) moved by `least` or more:
    entry_id, old_importance, new_importance. Rows from curated sources are left alone."""
    f = facts.where((F.col("updated_at") > now - days * DAY) & ~F.coalesce(F.col("source"), F.lit("")).isin(*curated))
    f = f.join(uses, "entry_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("new_importance", score)
    return f.where(F.abs(F.col("new_importance") - F.col("importance")) >= least).select("entry_id", F.col("importance").alias("old_importance"), "new_importance")


def signal_score(base: Column, text: Column, tech: Sequence[str], emotion: Column, uses: Column, noise: Column, weights: dict[str, float]) -> Column:
    """Importance of a text from seven signals (kind, length, questions, technical words, emotion, novelty, use), weighted, less noise."""
    low, hits = F.lower(F.coalesce(text, F.lit(""))), F.lit(0)
    for w in tech:
        hits = hits + F.contains(low, F.lit(w)).cast("int")
    one = lambda c: F.least(F.lit(1.0), c)
    signals = {
        "base": base, "length": one(F.length(low) / 800), "question": one(0.5 * F.regexp_count(low, F.lit("\\?"))), "tech": one(0.25 * hits),
        "emotion": emotion, "novelty": F.lit(0.7), "retrieval": F.when(uses > 0, one(F.log1p(uses) / 5)).otherwise(0.2),
    }
    total = sum((weights[k] * v for k, v in signals.items()), F.lit(0.0)) / sum(weights[k] for k in signals)
    return F.greatest(F.lit(0.0), one(total * (1 - noise)))


# -- episodes -----------------------------------------------------------------------------


def to_promote(episodes: DataFrame, most: int = 10, least: float = 0.7, seen: str = "l4:seen") -> DataFrame:
    """The oldest `most` episodes over the weight that promotion hasn't seen, with the value they'd get and their new tags."""
    new = episodes.where((F.col("weight") > least) & ~F.array_contains("tags", seen))
    return new.orderBy("created_at", "episode_id").limit(most).select("episode_id", F.substring("summary", 1, 200).alias("value"), F.array_union("tags", F.array(F.lit(seen))).alias("tags"))


def to_compress(episodes: DataFrame, now: int, days: int = 30, below: float = 0.3) -> DataFrame:
    """Episodes of little weight, older than `days`."""
    return episodes.where((F.col("weight") < below) & (F.col("created_at") < now - days * DAY))


def twin_classes(episodes: DataFrame) -> DataFrame:
    """Groups of equal user and summary of two or more: class and the episode to keep.

    no_raw: none names a journal row; diff_raw: they name several; skip_partial: not each names it; skip_variant: they
    differ elsewhere; same_raw: one can stay for all (the oldest)."""
    raw = F.array_sort(F.filter("tags", lambda t: t.startswith("raw:")))
    e = episodes.withColumn("_raw", raw).withColumn("_one", F.sha2(F.to_json(F.struct("tags", "weight")), 256)).withColumn("_h", F.sha2("summary", 256))
    g = e.groupBy("user_id", "_h").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("_raw"))).alias("_raws"), F.min(F.size("_raw")).alias("_least"), F.count_distinct("_one").alias("_kinds"), F.min_by("episode_id", F.struct("created_at", "episode_id")).alias("first"))
    kind = F.when(F.size("_raws") == 0, "no_raw").when(F.size("_raws") > 1, "diff_raw").when(F.col("_least") == 0, "skip_partial").when(F.col("_kinds") > 1, "skip_variant").otherwise("same_raw")
    return g.where("n > 1").select("user_id", "first", "n", kind.alias("class"))


def add_tag(rows: DataFrame, tag: Column) -> DataFrame:
    """Idempotent: a tag that is there stays once."""
    return rows.withColumn("tags", F.array_union("tags", F.array(tag)))


# -- journal ------------------------------------------------------------------------------


def purge_plan(marked: DataFrame, episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """marked (id): the episodes (tag raw:id) and facts (source_raw_id) that come from those journal rows: kind and id."""
    raw = episodes.select("episode_id", F.explode(F.filter("tags", lambda t: t.rlike("^raw:[0-9]{1,18}$"))).alias("t")).select("episode_id", F.substring("t", 5, 18).cast("long").alias("id"))
    a = raw.join(marked, "id", "left_semi").select(F.lit("episode").alias("kind"), F.col("episode_id").alias("id")).distinct()
    return a.unionByName(facts.join(marked.select(F.col("id").alias("source_raw_id")), "source_raw_id", "left_semi").select(F.lit("fact").alias("kind"), F.col("entry_id").alias("id")))


def redated(derived: DataFrame, journal: DataFrame, least: int = 1) -> DataFrame:
    """derived (id, raw_id, created_at), journal (raw_id, ts): rows whose time is off by `least` seconds or more, with the time of their source."""
    met = derived.join(journal.select("raw_id", "ts"), "raw_id")
    return met.where(F.abs(F.col("created_at") - F.col("ts")) >= least).select("id", "created_at", F.col("ts").alias("new_created_at"))


def drilled_down(facts: DataFrame, journal: DataFrame, cold: DataFrame) -> DataFrame:
    """facts (entry_id, source_raw_id) with the text they come from: the journal's, else the cold archive's."""
    j, c = journal.select(F.col("id").alias("source_raw_id"), F.col("text").alias("_hot")), cold.select(F.col("id").alias("source_raw_id"), F.col("text").alias("_cold"))
    met = facts.join(j, "source_raw_id", "left").join(c, "source_raw_id", "left")
    return met.select("entry_id", F.coalesce("_hot", "_cold").alias("text"), F.when(F.col("_hot").isNotNull(), "journal").when(F.col("_cold").isNotNull(), "cold").alias("found_in"))


def overdue(journal: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Received rows older than `days` are closed, with the decision appended."""
    late = (F.col("status") == "received") & (F.col("ts") < now - days * DAY)
    return journal.withColumn("decisions", F.when(late, F.array_append("decisions", F.lit("ttl_expired"))).otherwise(F.col("decisions"))).withColumn("status", F.when(late, "gated_out").otherwise(F.col("status")))


def to_replay(journal: DataFrame, judged: DataFrame, gate: str, config: str, most: int | None = None) -> DataFrame:
    """Rows not judged yet by this gate under this configuration (judged: id, gate, config_hash), oldest first; `most` bounds a run."""
    done = judged.where((F.col("gate") == gate) & (F.col("config_hash") == config)).select("id").distinct()
    left = journal.join(done, "id", "left_anti").orderBy("ts", "id")
    return left if most is None else left.limit(most)


def within_cost(events: DataFrame, keys: list[str], cost: str, most: float, seconds: int = 3600, at: str = "ts") -> DataFrame:
    """events with spent, the cost of the last `seconds` with their own, and whether that is within the cap."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds + 1, 0)
    return events.withColumn("spent", F.sum(cost).over(w)).withColumn("within", F.col("spent") <= most)


def staged(buffer: DataFrame, keys: list[str], now: int, hours: int = 24, most: int = 500) -> DataFrame:
    """A staging buffer after its sweep: rows younger than `hours`, the newest `most` of each key."""
    return wn.newest(buffer.where(F.col("ts") >= now - hours * 3600), keys, most, F.desc("ts"), F.desc("id"))


# -- gaps, projects, pages ----------------------------------------------------------------


def gap_registry(known: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """known (gap, seen_count, last_seen), seen (gap, n): gaps seen again count on, new ones begin, the others stay."""
    met = known.join(seen, "gap", "full")
    return met.select("gap", (F.coalesce("seen_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen_count"), F.when(F.col("n").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"))


def merged_rows(current: DataFrame, new: DataFrame, keys: list[str], empty_keeps: Sequence[str] = ()) -> DataFrame:
    """An upsert by key in which new values win where they're given: not null, and not empty for the columns in empty_keeps."""
    other = [c for c in current.columns if c not in keys]
    given = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in other])
    pick = lambda c: F.coalesce(F.when(F.col(f"_{c}") != "", F.col(f"_{c}")) if c in empty_keeps else F.col(f"_{c}"), F.col(c)).alias(c)
    return current.join(given, keys, "full").select(*keys, *map(pick, other))


def saved_pages(index: DataFrame, files: DataFrame) -> DataFrame:
    """index and files (path, content): path and action of a reindex: insert, update, skip (equal hashes) or orphan (no file)."""
    i, f = (df.select("path", F.sha2("content", 256).alias(h)) for df, h in ((index, "_i"), (files, "_f")))
    action = F.when(F.col("_i").isNull(), "insert").when(F.col("_f").isNull(), "orphan").when(F.col("_i") == F.col("_f"), "skip").otherwise("update")
    return i.join(f, "path", "full").select("path", action.alias("action"))


def hub_pages(pages: DataFrame, least: int = 3) -> DataFrame:
    """pages (type, title, updated_at): for each type of `least` pages or more one text that lists them, newest first."""
    held = pages.groupBy("type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("updated_at")).alias("k"), "title"))).alias("_p"))
    return held.where(F.col("n") >= least).select("type", "n", F.array_join(F.transform("_p", lambda p: F.concat(F.lit("- [["), p["title"], F.lit("]]"))), "\n").alias("content"))


def promoted_pages(facts: DataFrame, titles: DataFrame, kinds: Sequence[str], least: float = 0.8) -> DataFrame:
    """Facts of the kinds, important enough, whose key is no page's title yet; of facts of one key the first."""
    new = facts.where(F.col("memory_kind").isin(*kinds) & (F.col("importance") >= least)).join(titles.select(F.col("title").alias("key")), "key", "left_anti")
    return wn.latest(new, ["key"], F.desc("importance"), F.asc("entry_id"))


def reinforced_pages(pages: DataFrame, reads: DataFrame, now: int, hours: int = 24, boost: float = 0.05) -> DataFrame:
    """pages (page_id, confidence, updated_at), reads (page_id, ts): read within the window and after their last write: + boost, 1 at most."""
    last = reads.where(F.col("ts") >= now - hours * 3600).groupBy("page_id").agg(F.max("ts").alias("_read"))
    met = pages.join(last, "page_id", "left")
    return met.withColumn("confidence", F.when(F.col("_read") > F.col("updated_at"), F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.col("confidence"))).drop("_read")


# -- graph --------------------------------------------------------------------------------


def edges_with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the contents of both ends; both must be there."""
    of = lambda k: nodes.select(F.col("node_id").alias(f"{k}_id"), F.col("content").alias(f"{k}_content"))
    return edges.join(of("source"), "source_id").join(of("target"), "target_id")


def edge_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges in all, live (both ends there), dead, and across layers."""
    of = lambda k: nodes.select(F.col("node_id").alias(f"{k}_id"), F.col("layer").alias(f"_{k}"))
    e = edges.join(of("source"), "source_id", "left").join(of("target"), "target_id", "left")
    live = F.col("_source").isNotNull() & F.col("_target").isNotNull()
    return e.agg(F.count("*").alias("total"), F.count_if(live).alias("live"), F.count_if(~live).alias("dead"), F.count_if(live & (F.col("_source") != F.col("_target"))).alias("across"))


def near_sessions(nodes: DataFrame, spans: DataFrame, window: int = 300) -> DataFrame:
    """nodes (node_id, created_at), spans (session_id, ts): sessions with an event within `window` seconds of a node, by time buckets.

    A session's times whose windows touch are one interval first, so a node of one time meets each session once and
    its pairs aren't shuffled; only those of nodes with several times are made distinct."""
    own = Window.partitionBy("session_id").orderBy("ts")
    apart = F.coalesce((F.col("ts") - F.lag("ts").over(own) > 2 * window).cast("int"), F.lit(1))
    runs = spans.select("session_id", "ts").where("ts is not null").withColumn("_new", apart).withColumn("_run", F.sum("_new").over(own))
    runs = runs.groupBy("session_id", "_run").agg((F.min("ts") - window).alias("_from"), (F.max("ts") + window).alias("_to"))
    bucket = lambda c: F.floor(F.col(c) / window)
    s = runs.select("session_id", "_from", "_to", F.explode(F.sequence(bucket("_from"), bucket("_to"))).alias("_b"))
    n = nodes.select("node_id", "created_at").distinct().withColumn("_n", F.count("node_id").over(Window.partitionBy("node_id"))).withColumn("_b", bucket("created_at"))
    of = lambda some: n.where(some).join(s, "_b").where(F.col("created_at").between(F.col("_from"), F.col("_to"))).select("node_id", "session_id")
    return of("_n = 1").unionByName(of("_n <> 1").distinct())


def provenance_edges(facts: DataFrame) -> DataFrame:
    """facts (node_id, parents): an edge sourced_from each episode that a fact names; the episode nodes are their anchors."""
    p = facts.select("node_id", F.explode(F.filter("parents", lambda x: x.startswith("episode:"))).alias("target_id"))
    return p.select(F.col("node_id").alias("source_id"), "target_id", F.lit("sourced_from").alias("relation"), F.lit(0.5).alias("weight")).distinct()


def shared_entities(nodes: DataFrame, entities: Sequence[str], most: int = 12) -> DataFrame:
    """nodes (layer, node_id, words): co_mentions edges between nodes that share one of the entities, `most` for each node in order."""
    from .caps import capped_groups

    held = nodes.select("layer", "node_id", F.explode(F.array_intersect("words", F.array(*map(F.lit, entities)))).alias("group"))
    return capped_groups(held, most).withColumn("weight", F.lit(0.4))


def tool_triplets(pairs: DataFrame) -> DataFrame:
    """tool_pairs() as edges: query led_to tool call, tool call led_to its outcome (ok or error)."""
    call = F.concat_ws(":", F.lit("action"), "tool", "argument")
    outcome = F.concat_ws(":", F.lit("outcome"), F.when(F.col("is_error"), "error").otherwise("ok"), F.substring("result", 1, 80))
    a = pairs.select(F.concat_ws(":", F.lit("query"), "argument").alias("source_id"), call.alias("target_id"))
    return a.unionByName(pairs.select(call.alias("source_id"), outcome.alias("target_id"))).distinct().withColumn("relation", F.lit("led_to"))


def question_nodes(failed: DataFrame, keys: list[str], least: int = 2, most: int = 20) -> DataFrame:
    """failed (keys, query): queries that found nothing `least` times or more, the most frequent `most`, as question nodes."""
    n = failed.groupBy(*keys, F.sha2(F.lower("query"), 256).alias("query_hash")).agg(F.min("query").alias("query"), F.count("*").alias("n"))
    return n.where(F.col("n") >= least).orderBy(F.desc("n"), *keys, "query").limit(most).select(*keys, F.substring("query", 1, 300).alias("content"), "n")


def find_or_add(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (user_id, content, node_type): those that no node is yet, once each, named by a hash of what they are."""
    new = wanted.distinct().join(nodes.select("user_id", "content", "node_type").distinct(), ["user_id", "content", "node_type"], "left_anti")
    return new.withColumn("node_id", F.substring(F.sha2(F.concat_ws("|", "user_id", "node_type", "content"), 256), 1, 16))


def temporal_chain(events: DataFrame, links: DataFrame, start: DataFrame, forward: bool = True) -> DataFrame:
    """start (event_id): the events one link after (or before) each."""
    a, b = ("from_event", "to_event") if forward else ("to_event", "from_event")
    return start.join(links, start["event_id"] == links[a]).select(F.col("event_id").alias("origin"), F.col(b).alias("event_id")).join(events, "event_id")


def fact_links(pages: DataFrame, facts: DataFrame, ident: str = "page_id", text: str = "html") -> DataFrame:
    """[[fact:key]] marks of pages: page, key and whether there is such a fact."""
    keys = pages.select(ident, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("\\[\\[fact:([^\\]]+)\\]\\]"), 1))).alias("key"))
    return keys.join(facts.select("key", F.lit(True).alias("_there")).distinct(), "key", "left").select(ident, "key", F.coalesce("_there", F.lit(False)).alias("found"))


def evidence(facts: DataFrame, journal: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """facts (keys, entry_id, words), journal (keys, words): exists where a row of the same keys holds all words of a fact,
    probable where one shares `least`, else unknown. Facts and rows meet in blocks, where rows are bits, so no pair of them is ever written."""
    f, j = facts.select(*keys, "entry_id", "words").where("size(words) > 0"), journal.select(*keys, "words").where("size(words) > 0")
    left, right = jn.in_blocks(f, j, keys, EVIDENCE_BLOCK)
    cell = [*keys, "_i", "_j"]
    kind = facts.schema["entry_id"].dataType.simpleString()
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(lambda x, y: _evidence(x, y, least), f"entry_id {kind}, v int")
    best = met.groupBy("entry_id").agg(F.max("v").alias("_v"))
    return facts.select("entry_id").join(best, "entry_id", "left").select("entry_id", F.when(F.col("_v") == 2, "exists").when(F.col("_v") == 1, "probable").otherwise("unknown").alias("verdict"))


def _evidence(facts: pa.Table, rows: pa.Table, least: int) -> pa.Table:
    """Of each fact with 2 if a row has all of its words, 1 if one has `least`; others are left out."""
    if not len(facts) or not len(rows):
        return pa.table({"entry_id": facts["entry_id"].slice(0, 0), "v": pa.array([], pa.int32())})
    words = facts["words"].combine_chunks()
    names = words.flatten().unique()
    bits = jn.bitmaps(rows["words"].combine_chunks(), names)
    owner, size = pc.list_parent_indices(words).to_numpy(), pc.list_value_length(words).to_numpy()
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = np.full((len(facts), size.max()), len(names))
    at[owner, place] = pc.index_in(words.flatten(), value_set=names).to_numpy()
    v = np.zeros(len(facts), np.int32)
    for i in range(0, len(facts), 256):
        some = at[i : i + 256]
        whole = np.full((len(some), bits.shape[1]), 255, np.uint8)
        # from_[t]: rows with more than t of the words so far.
        from_ = np.zeros((least, *whole.shape), np.uint8)
        for k in range(some.shape[1]):
            here = bits[some[:, k]]
            whole &= np.where((some[:, k] == len(names))[:, None], np.uint8(255), here)
            for t in range(least - 1, 0, -1):
                from_[t] |= from_[t - 1] & here
            from_[0] |= here
        v[i : i + 256] = np.where(whole.any(1), 2, from_[-1].any(1))
    found = np.flatnonzero(v)
    return pa.table({"entry_id": facts["entry_id"].take(pa.array(found)), "v": v[found]})


def equal_values(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose value another row of their keys has, too."""
    n = facts.groupBy(*keys, "value").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = reduce(and_, [facts[k].eqNullSafe(n[k]) for k in [*keys, "value"]])
    return facts.join(n, same, "left_semi")


def report_card(audit: DataFrame) -> DataFrame:
    """One row: counts of actions, and integrity = 100 x verified / (verified + dropped) with a decimal, null without either."""
    good, bad = F.count_if(F.col("action") == "click"), F.count_if(F.col("action") == "error")
    return audit.agg(F.count("*").alias("n"), good.alias("verified"), bad.alias("dropped"), F.round(F.try_divide(100 * good, good + bad), 1).alias("integrity"))


def neighbours_of_time(events: DataFrame, probes: DataFrame, keys: list[str], window: int = 3600) -> DataFrame:
    """probes (keys, probe_id, at): the events of the same keys less than `window` seconds away, by time buckets."""
    e = events.withColumn("_b", F.floor(F.col("ts") / window))
    p = probes.withColumn("_b", F.explode(F.array(*[F.floor(F.col("at") / window) + k for k in (-1, 0, 1)])))
    return p.join(e, [*keys, "_b"]).where(F.abs(F.col("ts") - F.col("at")) < window).drop("_b")


def cohesion(records: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """Mean likeness of all pairs of a segment's records (segments are bounded), 0 for one record."""
    w = records.groupBy(*keys).agg(F.collect_list(words).alias("_all"))
    n = F.size("_all")
    pairs = F.flatten(F.transform("_all", lambda a, i: F.transform(F.slice("_all", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: _likeness(a, b))))
    return w.select(*keys, F.when(n > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)).otherwise(0.0).alias("cohesion"))


def _likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(F.array_union(a, b))
    return F.when(any_ > 0, both / any_).otherwise(0.0)


def chunk_hits(chunks: DataFrame, pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of chunks (chunk_id, score) as scores of pages: the best chunk of each page."""
    return scores.join(chunks, "chunk_id").join(pages.select("page_id"), "page_id").groupBy("page_id").agg(F.max("score").alias("score"))


def related_facts(links: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """links (page, node_id): facts whose value is the content of a node next to a page's node.

    Nodes whose content no fact has are left out first, and what a page's nodes hold is made distinct before it meets the facts, so a fact
    with one value is found once and only those with several need another look. Pages and facts of a value meet as lists,
    dealt to DEALT tasks by page; the pairs are neither sorted nor kept."""
    every = facts.select("entry_id", "value").where("value is not null").distinct()
    there = nodes.select("node_id", F.col("content").alias("value")).join(every.select("value").distinct(), "value", "left_semi")
    near = links.select("page", F.col("node_id").alias("node")).join(jn.both_ways(edges), "node").select("page", F.col("neighbour").alias("node_id"))
    held = near.join(there.hint("shuffle_hash"), "node_id").select("page", "value").distinct()
    dealt = held.withColumn("_d", F.pmod(F.xxhash64("page"), F.lit(DEALT)).cast("int"))
    to_all = lambda df: df.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    # A null entry_id counts as one of several values, so its rows are made distinct, too.
    every = every.withColumn("_n", F.count("entry_id").over(Window.partitionBy("entry_id")))
    part = lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.lit(PARTS))
    listed = lambda df, most, *keys, c: df.groupBy(*keys, part(F.col(c)).alias("_p")).agg(F.collect_list(F.struct(c)).alias("_l")).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / most).cast("int")), lambda k: F.slice("_l", k * most + 1, most))).alias(f"{c}s"))
    met = listed(dealt, PAGES, "value", "_d", c="page").join(to_all(listed(every.where("_n = 1"), FACTS, "value", c="entry_id")), ["value", "_d"])
    once = met.select(F.explode("pages").alias("_a"), "entry_ids").select("_a", F.explode("entry_ids").alias("_b")).select("_a.page", "_b.entry_id")
    several = dealt.join(to_all(every.where("_n <> 1")), ["value", "_d"]).select("page", "entry_id").distinct()
    return once.unionByName(several)
