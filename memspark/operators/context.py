"""Context for a prompt: blocks packed under a budget of tokens, in order or by floors and ceilings of their sources.

Whether a block fits depends on all before it, so a user's blocks are walked in one group. Groups are bounded: of each source
the `most` first blocks of a user come in, cut by rank before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Shares of a budget by source; the least ceiling; characters that tell blocks apart; characters of an injected block.
WEIGHTS = {"important": 0.30, "relevant": 0.30, "recent": 0.15, "day": 0.15, "ops": 0.10}
LEAST_CEILING, KEY_CHARS, BLOCK_CHARS = 40, 80, 400
#: Blocks of a source that are looked at, for each user.
MOST = 50


def block_key(content: Column) -> Column:
    """What near-equal blocks share: the first characters with blanks made one."""
    return F.substring(F.trim(F.regexp_replace(content, "\\s+", " ")), 1, KEY_CHARS)


def _candidates(sources: Mapping[str, DataFrame], keys: Sequence[str], most: int) -> DataFrame:
    """Blocks of all sources: keys, source, _s (its place), _k (place of the block), score, content, cost, key, also."""
    out = None
    for i, (name, df) in enumerate(sources.items()):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
        extra = F.transform("also", block_key) if "also" in df.columns else F.array().cast("array<string>")
        rows = df.withColumn("_k", rank).where(F.col("_k") <= most)
        one = rows.select(*keys, F.lit(name).alias("source"), F.lit(i).alias("_s"), "_k", F.col("score").cast("double").alias("score"), F.trim("content").alias("content"), extra.alias("also"))
        out = one if out is None else out.unionByName(one)
    kept = out.where("content <> ''")
    return kept.withColumn("cost", tx.estimate_tokens(F.col("content"))).withColumn("key", block_key(F.col("content")))


def _walked(rows: DataFrame, keys: Sequence[str], choose) -> DataFrame:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_s", "_k"], kind="stable").reset_index(drop=True)
        at = choose(group)
        out = group.loc[at, [*keys, "source", "content", "score", "cost"]].assign(place=range(1, len(at) + 1))
        return out.rename(columns={"cost": "tokens"})

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(pack, f"{schema}, source string, content string, score double, tokens long, place int")


def pack_in_order(sources: Mapping[str, DataFrame], keys: Sequence[str], budget: int, most: int = MOST) -> DataFrame:
    """sources: name to (keys, place, score, content and, if wanted, also: further contents that a block stands for), in order.

    A block comes in if it isn't blank, nothing before it began alike, and its tokens fit into what is left of the budget; later ones
    may still fit. Returns keys, source, content, score, tokens and place."""

    def choose(group: pd.DataFrame) -> list[int]:
        left, seen, chosen = budget, set(), []
        for i, (cost, key, also) in enumerate(zip(group["cost"], group["key"], group["also"])):
            if key not in seen and cost <= left:
                chosen.append(i)
                left -= cost
                seen |= {key, *also}
        return chosen

    return _walked(_candidates(sources, keys, most), keys, choose)


def pack_by_weights(sources: Mapping[str, DataFrame], keys: Sequence[str], budget: int, weights: Mapping[str, float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Blocks under floors and ceilings: first each source is filled up to its share of the budget, then what is left goes, heaviest source
    first, to further blocks until a source has twice its share (LEAST_CEILING at least).

    The first source in the order of weights that has a content keeps it. Returns what pack_in_order() does."""
    floors = {s: int(budget * w) for s, w in weights.items()}
    ceilings = {s: max(2 * f, LEAST_CEILING) for s, f in floors.items()}

    def choose(group: pd.DataFrame) -> list[int]:
        seen, chosen, used = set(), [], dict.fromkeys(weights, 0)
        of = {s: g.index.tolist() for s, g in group.groupby("source", sort=False)}
        cost, key = group["cost"].tolist(), group["key"].tolist()

        def fill(source: str, cap: int) -> None:
            for i in of.get(source, []):
                if used[source] >= cap:
                    break
                if key[i] not in seen and used[source] + cost[i] <= cap:
                    seen.add(key[i])
                    chosen.append(i)
                    used[source] += cost[i]

        for s in weights:
            fill(s, floors[s])
        for s in sorted(weights, key=lambda s: -weights[s]):
            left = budget - sum(used.values())
            if left > 0:
                fill(s, min(used[s] + left, ceilings[s]))
        return chosen

    return _walked(_candidates({s: sources[s] for s in weights if s in sources}, keys, most), keys, choose)


def recall_protocol(axes: Mapping[str, DataFrame], users: DataFrame, keys: Sequence[str], budget: int = 2000) -> DataFrame:
    """Blocks of the axes markers, session, semantic, expand, triggered and day, in this order, under one budget.

    users (keys, query): a blank query gets markers and day alone."""
    order = ["markers", "session", "semantic", "expand", "triggered", "day"]
    full = users.where(F.trim(F.coalesce("query", F.lit(""))) != "").select(*keys)
    asked = {a: axes[a] if a in ("markers", "day") else axes[a].join(full, list(keys), "left_semi") for a in order if a in axes}
    return pack_in_order({a: df.join(users.select(*keys), list(keys), "left_semi") for a, df in asked.items()}, keys, budget)


def joined(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], part: Column, most: int, sep: str, score: float, head: str = "", chars: int | None = None) -> DataFrame:
    """One block of the first `most` parts of each key: keys, place, score, content and also (the parts)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("_p", part).withColumn("_k", rank).where(F.col("_k") <= most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_p"))), lambda x: x["_p"])
    text = F.concat(F.lit(head), F.array_join("also", sep))
    found = first.groupBy(*keys).agg(parts.alias("also"))
    return found.select(*keys, F.lit(1).alias("place"), F.lit(score).alias("score"), (F.substring(text, 1, chars) if chars else text).alias("content"), "also")


def inject_blocks(pinned: DataFrame, hits: DataFrame, facts: DataFrame, keys: Sequence[str], budget: int = 2000, order: Sequence[Column] | None = None) -> DataFrame:
    """Blocks for a prompt: the ten first pinned facts (key, value; by order or else key) as one block first, then hits and important facts (place, score, content).

    Every block is cut to BLOCK_CHARS characters; one that doesn't fit is left out and those behind it may still fit."""
    first = joined(pinned, keys, order or [F.col("key"), F.col("value")], F.concat(F.lit("📌 "), F.col("key"), F.lit("="), F.substring("value", 1, 80)), 10, "; ", 1.0, chars=BLOCK_CHARS).drop("also")
    short = lambda df: df.withColumn("content", F.substring("content", 1, BLOCK_CHARS))
    return pack_in_order({"pinned": first, "relevant": short(hits), "facts": short(facts)}, keys, budget, 10)


def session_recap(sessions: DataFrame, checkpoints: DataFrame, pending: DataFrame, day: DataFrame, keys: Sequence[str], budget: int = 2000) -> DataFrame:
    """The pack that opens a new session: the last session with messages (summary, n_messages, at), the newest
    checkpoint (content, at), what is pending (content, at; five, in one line) and the day's blocks (place, score, content)."""
    newest = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at")))).where("_n = 1")
    one = lambda df, head, chars, score: df.select(*keys, F.lit(1).alias("place"), F.lit(score).alias("score"), F.concat(F.lit(head), F.substring("content", 1, chars)).alias("content"))
    last = newest(sessions.where("n_messages > 0")).withColumnRenamed("summary", "content")
    return pack_in_order(
        {
            "recap_session": one(last, "last session: ", 160, 0.9),
            "recap_checkpoint": one(newest(checkpoints), "checkpoint: ", 220, 0.95),
            "recap_pending": joined(pending, keys, [F.desc("at")], F.concat(F.lit("pad:"), F.substring("content", 1, 60)), 5, " | ", 0.8).drop("also"),
            "day": day,
        },
        keys,
        budget,
    )
