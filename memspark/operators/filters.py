"""Filters and predicates over memory tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

HUB_TYPES = ("moc", "auto_index")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def facet_filter(tags: Column, wanted: Sequence[str]) -> Column:
    """Tags of one dimension (before the colon) are alternatives, dimensions must all match; a plain tag is its own dimension."""
    by_dimension: dict[str, list[str]] = {}
    for tag in dict.fromkeys(wanted):
        by_dimension.setdefault(tag.split(":", 1)[0] if ":" in tag else tag, []).append(tag)
    return all_of([F.arrays_overlap(tags, F.array(*map(F.lit, group))) for group in by_dimension.values()])


def query_memory(df: DataFrame, source: str = "core", *, importance_min: float | None = None, importance_max: float | None = None, tag: str = "", layer: str = "", user_id: str = "", key_like: str = "", content_like: str = "", created_since: int = 0, created_until: int = 0, tags: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """The filter language: every given condition must hold; newest first, ties by id; 1 to 200 rows.

    tag is one exact tag, tags are facets (see facet_filter); layer and user_id narrow the scope."""
    if source not in ("core", "episodes"):
        raise ValueError(f"unknown source {source}")
    if source == "core" and (tags or tag):
        raise ValueError("facts have no tags")
    if source == "episodes" and key_like:
        raise ValueError("episodes have no key")
    core = source == "core"
    content, weight, ident = ("value", "importance", "entry_id") if core else ("summary", "weight", "episode_id")
    conditions = [facet_filter(F.col("tags"), tags)] if tags else []
    if importance_min is not None:
        conditions.append(F.col(weight) >= importance_min)
    if importance_max is not None:
        conditions.append(F.col(weight) <= importance_max)
    if tag:
        conditions.append(F.array_contains("tags", tag))
    conditions += [F.col(k) == v for k, v in (("layer", layer), ("user_id", user_id)) if v]
    if key_like:
        conditions.append(F.contains(F.lower("key"), F.lit(key_like.lower())))
    if content_like:
        conditions.append(F.contains(F.lower(content), F.lit(content_like.lower())))
    if created_since:
        conditions.append(F.col("created_at") >= created_since)
    if created_until:
        conditions.append(F.col("created_at") < created_until)
    return df.where(all_of(conditions)).orderBy(F.desc("created_at"), F.desc(ident)).limit(max(1, min(200, limit)))


def matched_tokens(columns: Sequence[str], query_tokens: Sequence[str]) -> Column:
    """How many of the tokens occur in one of the columns, as substrings of their lower case."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return sum((F.contains(hay, F.lit(t)).cast("int") for t in query_tokens), F.lit(0))


def token_search(facts: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Facts with any of the query's tokens: the most important max(10 x limit, 50), then by matches and importance."""
    words = [w for w in query.lower().split() if w]
    hits = facts.withColumn("matches", matched_tokens(["key", "value"], words)).where("matches > 0")
    first = hits.orderBy(F.desc("importance"), F.desc("entry_id")).limit(max(10 * limit, 50))
    return first.orderBy(F.desc("matches"), F.desc("importance"), F.desc("entry_id")).limit(limit)


def active(now: int) -> Column:
    """Within its validity window (both ends count; open ends are null)."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= now)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= now))


def not_hub() -> Column:
    return ~F.col("node_type").isin(*HUB_TYPES)


def mark_expired(value: Column, expires_at: Column, now: int) -> Column:
    return F.when(expires_at < now, F.concat(F.lit("[EXPIRED] "), value)).otherwise(value)


def verified(hits: DataFrame, query: str, content: str = "content") -> DataFrame:
    """Hits that share a content word with the query; a query without any keeps all."""
    words = [w for w in dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split()) if len(w) >= 3 and w not in tx.STOP_WORDS]
    return hits.where(F.arrays_overlap(tx.content_tokens(F.col(content)), F.array(*map(F.lit, words)))) if words else hits


def matching_rules(texts: DataFrame, rules: Sequence[tuple[str, float, Sequence[str], Sequence[str]]], text: str = "text") -> DataFrame:
    """rules: name, boost, keywords, tags. Adds names, the summed boost (0.3 at most) and tags of the rules with a keyword in the text.

    Rules are a short configured list, so they become one expression instead of a join."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = {name: any_of([t.contains(k.lower()) for k in keywords]) for name, _, keywords, _ in rules}
    pick = lambda items: F.array_compact(F.array(*[F.when(hit[n], v) for n, v in items]))
    boost = sum((F.when(hit[n], b).otherwise(0.0) for n, b, *_ in rules), F.lit(0.0))
    found_tags = F.array_distinct(F.flatten(F.array(*[F.when(hit[n], F.array(*map(F.lit, ts))).otherwise(F.array().cast("array<string>")) for n, _, _, ts in rules])))
    return texts.select("*", pick([(n, F.lit(n)) for n, *_ in rules]).alias("rules"), F.least(F.lit(0.3), boost).alias("boost"), found_tags.alias("rule_tags"))


def archivable(facts: DataFrame, kinds: DataFrame, now: int, days: int = 90, importance: float = 0.3) -> DataFrame:
    """Expired goals and to-dos, and old facts of little importance of kinds that may be archived; the former first."""
    joined = facts.join(kinds, "memory_kind")
    expired = joined.where(F.col("needs_expiry") & ~F.col("never_archive") & (F.col("expires_at") < now)).withColumn("prio", F.lit(0))
    old = joined.where(~F.col("never_archive") & (F.col("importance") < importance) & (F.col("created_at") < now - days * 86_400) & ~(F.col("needs_expiry") & (F.coalesce("expires_at", F.lit(now)) < now))).withColumn("prio", F.lit(1))
    return expired.unionByName(old)


def looks_like_dump(text: Column) -> Column:
    """Raw tool output rather than speech: an opening bracket, fence or tag, or a tool marker near the start."""
    return text.rlike('^\\s*"?\\s*(\\[|\\{|\\]|`{3}|<|\\\\)') | F.substring(text, 1, 200).contains("tool_use_id")


def limit_of(value: int | None, default: int = 10, most: int = 200) -> int:
    return max(1, min(most, default if value is None else value))
