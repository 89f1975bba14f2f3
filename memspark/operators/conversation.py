"""Journals of conversations: tool calls and their results, topical segments, stranded rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

_BLOCKS = "array<struct<type: string, id: string, tool_use_id: string, name: string, input: string, content: string, is_error: boolean>>"
#: Segments: tokens and records at most, and how far a record may stray from what is open.
SEGMENT_TOKENS, SEGMENT_RECORDS, STRAY = 900, 10, 2.0


def tool_blocks(journal: DataFrame) -> DataFrame:
    """journal (id, ts, text): one row per tool_use or tool_result block, with its place. Texts that are no JSON have none."""
    found = F.from_json("text", _BLOCKS)
    blocks = journal.select(F.col("id").alias("row_id"), "ts", F.posexplode(found).alias("place", "block")).select("row_id", "ts", "place", "block.*")
    return blocks.where(F.col("type").isin("tool_use", "tool_result"))


def result_text(content: Column) -> Column:
    """A result's content as text: a string, or the texts of a list."""
    parts = F.from_json(content, "array<struct<text: string>>")
    listed = F.array_join(F.transform(parts, lambda p: p["text"]), " ")
    return F.trim(F.coalesce(F.when(content.startswith("["), listed), content, F.lit("")))


def argument_text(given: Column) -> Column:
    """The main argument of a call: query, pattern, command or q, else the first that isn't blank."""
    values = F.from_json(given, "map<string, string>")
    named = [F.element_at(values, k) for k in ("query", "pattern", "command", "q")]
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    first = F.get(F.filter(F.transform(F.map_values(values), text), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(*[text(c) for c in named], first, F.lit(""))


def tool_pairs(blocks: DataFrame) -> DataFrame:
    """Each result with the last call of its id that came before: tool, argument, result, is_error."""
    at = F.struct("ts", "row_id", "place")
    calls = blocks.where("type = 'tool_use' and id is not null")
    calls = calls.select(F.col("id").alias("call"), F.coalesce("name", F.lit("unknown")).alias("tool"), argument_text(F.col("input")).alias("argument"), at.alias("called"))
    results = blocks.where("type = 'tool_result' and tool_use_id is not null")
    results = results.select(F.col("tool_use_id").alias("call"), result_text(F.col("content")).alias("result"), F.coalesce("is_error", F.lit(False)).alias("is_error"), at.alias("came"))
    met = results.join(calls, "call").where("called < came")
    last = Window.partitionBy("call", "came").orderBy(F.desc("called"))
    return met.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("call", "tool", "argument", "result", "is_error")


def tool_stats(blocks: DataFrame) -> DataFrame:
    """tool, calls, errors, error_rate and mean_result of each tool; calls without a result count as calls."""
    calls = blocks.where("type = 'tool_use'").groupBy(F.coalesce("name", F.lit("unknown")).alias("tool")).agg(F.count("*").alias("calls"))
    ends = tool_pairs(blocks).groupBy("tool").agg(F.count_if("is_error").alias("errors"), F.avg(F.length("result")).alias("mean_result"))
    both = calls.join(ends, "tool", "left")
    return both.select("tool", "calls", F.coalesce("errors", F.lit(0)).alias("errors"), (F.coalesce("errors", F.lit(0)) / F.col("calls")).alias("error_rate"), F.coalesce("mean_result", F.lit(0.0)).alias("mean_result"))


def segments(records: DataFrame, keys: list[str], order: str, text: str = "text", most_tokens: int = SEGMENT_TOKENS, most_records: int = SEGMENT_RECORDS) -> DataFrame:
    """keys, the order column and segment_no (from 0): a conversation cut where its topic turns.

    A record opens a segment if it is full (in tokens or records), or if twice its surprise (one less its
    likeness to the last record or to all words so far, whichever is higher) and the drop in the mean
    likeness of the segment's records exceed STRAY. A conversation is one group; groups are as long as
    conversations are, and only word sets of the open segment (most_records at most) are held."""
    kinds = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in [*keys, order])
    rows = records.select(*keys, order, tx.tokens(F.col(text)).alias("_words"), F.greatest(F.floor(F.length(F.coalesce(text, F.lit(""))) / 4), F.lit(1)).cast("long").alias("_size"))

    def likeness(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a or b else 0.0

    def cut_up(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        numbers, now, held, size, sum_ = [], 0, [], 0, 0.0
        for words, tokens in zip(map(set, p["_words"]), p["_size"]):
            to_held = [likeness(words, h) for h in held]
            if held:
                n = len(held)
                before = sum_ / (n * (n - 1) / 2) if n > 1 else 0.0
                after = (sum_ + sum(to_held)) / (n * (n + 1) / 2)
                surprise = 1 - max(to_held[-1], likeness(words, set().union(*held)))
                if n >= most_records or size + tokens > most_tokens or 2 * surprise + max(0.0, before - after) > STRAY:
                    now, held, size, sum_, to_held = now + 1, [], 0, 0.0, []
            held.append(words)
            size, sum_ = size + tokens, sum_ + sum(to_held)
            numbers.append(now)
        return p[[*keys, order]].assign(segment_no=numbers)

    return rows.groupBy(*keys).applyInPandas(cut_up, f"{kinds}, segment_no long")


def stranded(received: DataFrame, facts: DataFrame, episodes: DataFrame, now: int, grace: int = 600) -> DataFrame:
    """received (id, layer, user_id, ts): id and verdict of each row older than the grace.

    promoted_l4 where a fact of the same layer and user names the row (source_raw_id), saved_l3 where an
    episode's tags do (raw:<id>), unaccounted otherwise."""
    scope = ["layer", "user_id", "id"]
    by_fact = facts.select("layer", "user_id", F.col("source_raw_id").alias("id"), F.lit(True).alias("_fact")).distinct()
    raw = F.filter("tags", lambda t: t.rlike("^raw:[0-9]{1,18}$"))
    by_episode = episodes.select("layer", "user_id", F.explode(F.transform(raw, lambda t: F.substr(t, F.lit(5)).cast("long"))).alias("id"), F.lit(True).alias("_episode")).distinct()
    old = received.where(F.col("ts") <= now - grace).join(by_fact, scope, "left").join(by_episode, scope, "left")
    return old.select("id", F.when(F.col("_fact"), "promoted_l4").when(F.col("_episode"), "saved_l3").otherwise("unaccounted").alias("verdict"))


# The steps that a memory may take.
STEPS = [("staging", "l4"), ("episode", "l4"), ("episode", "archived"), ("l4", "archived"), ("l2_session", "archived")]


def legal_steps(moves: DataFrame) -> DataFrame:
    """The moves (from_state, to_state, ...) that are allowed, with their kind."""
    ok = F.struct("from_state", "to_state").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in STEPS])
    return moves.where(ok).withColumn("kind", F.concat_ws("->", "from_state", "to_state"))


def pending(proposals: DataFrame, decided: DataFrame, identity: list[str], keep: int) -> DataFrame:
    """proposals and decided (identity, at; proposals have payload, too): one pending row for each identity.

    A proposal within `keep` seconds of an earlier rejection of its identity is absorbed by that. Of the
    others the latest payload wins and counts from then: identity, first_at, at, payload, n."""
    w = Window.partitionBy(*identity).orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = proposals.select(*identity, "at", "payload", F.lit(1).alias("_side")).unionByName(decided.select(*identity, "at", F.lit(None).cast(proposals.schema["payload"].dataType).alias("payload"), F.lit(0).alias("_side")))
    seen = both.withColumn("_last", F.max(F.when(F.col("_side") == 0, F.col("at"))).over(w)).where("_side = 1")
    open_ = seen.where(F.col("_last").isNull() | (F.col("at") - F.col("_last") >= keep))
    return open_.groupBy(*identity).agg(F.min("at").alias("first_at"), F.max("at").alias("at"), F.max_by("payload", F.struct("at", "payload")).alias("payload"), F.count("*").alias("n"))
