"""Upserts, history, ageing and archiving as functions from tables to their next versions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import decayed
from . import windows as wn

DAY = 86_400
SCOPE = ["user_id", "key"]


def upsert(current: DataFrame, saves: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The next version of a fact table: of each key the latest row by created_at, then entry_id."""
    keys = keys or SCOPE
    return wn.latest(current.unionByName(saves), keys, F.desc("created_at"), F.desc("entry_id"))


def history(versions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The ledger of changes: old and new value, and a commit hash of key, value and time (16 hex digits)."""
    keys = keys or SCOPE
    w = Window.partitionBy(*keys).orderBy("created_at", "entry_id")
    old = F.lag("value").over(w)
    rows = versions.select(*keys, "entry_id", "created_at", old.alias("old_value"), F.col("value").alias("new_value"))
    changed = rows.where(F.col("old_value").isNull() | (F.col("old_value") != F.col("new_value")))
    return changed.withColumn("commit_hash", F.substring(F.sha2(F.concat_ws("|", *keys, "new_value", F.col("created_at").cast("string")), 256), 1, 16))


def delete(current: DataFrame, gone: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return current.join(gone, keys or SCOPE, "left_anti")


def purge_since(df: DataFrame, cutoff: int) -> DataFrame:
    """Drops what is newer than the cutoff."""
    return df.where(F.col("created_at") <= cutoff)


def restore(current: DataFrame, snapshot: DataFrame, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """What going back to a snapshot takes: rows to write (new or changed there) and keys to delete."""
    keys = keys or SCOPE
    now = current.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("_value"))
    same = reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys]) & F.col("value").eqNullSafe(F.col("_value"))
    write = snapshot.join(now, same, "left_anti")
    return {"write": write, "delete": current.join(snapshot, keys, "left_anti").select(*keys)}


def decay(facts: DataFrame, kinds: DataFrame, now: int) -> DataFrame:
    """facts with new_importance after the days since created_at; changed tells whether it is worth writing."""
    days = F.greatest(F.lit(now) - F.col("created_at"), F.lit(0)) / DAY
    out = facts.join(kinds, "memory_kind").withColumn("new_importance", decayed(F.col("importance"), F.col("decay_rate"), days))
    return out.withColumn("changed", F.abs(F.col("new_importance") - F.col("importance")) > 1e-3)


def compact(facts: DataFrame, kinds: DataFrame, now: int, budget: int) -> DataFrame:
    """The `budget` facts of each user with the highest activation; the rest are evicted. Kinds never archived stay."""
    days = F.greatest(F.lit(now) - F.col("created_at"), F.lit(0)) / DAY
    act = facts.join(kinds, "memory_kind").withColumn("activation", F.col("importance") * F.exp(-F.col("decay_rate") * days))
    w = Window.partitionBy("user_id").orderBy(F.desc(F.col("never_archive")), F.desc(F.round("activation", 9)), F.asc("entry_id"))
    return act.withColumn("place", F.row_number().over(w)).withColumn("evicted", (F.col("place") > budget) & ~F.col("never_archive"))


def sweep_expired(facts: DataFrame, kinds: DataFrame, now: int, remain: int = 50, stop_share: float = 0.8) -> DataFrame:
    """facts with swept: expired ones, oldest expiry first, so that `remain` rows of a user are left; nothing if over
    stop_share of what could be swept has expired at once. Kinds never archived are exempt."""
    f = facts.join(kinds, "memory_kind").withColumn("_can", ~F.col("never_archive") & F.col("expires_at").isNotNull()).withColumn("_due", F.col("_can") & (F.col("expires_at") < now))
    by = Window.partitionBy("user_id")
    f = f.withColumn("_n", F.count("*").over(by)).withColumn("_cans", F.count_if("_can").over(by)).withColumn("_dues", F.count_if("_due").over(by))
    place = F.row_number().over(by.orderBy(F.desc("_due"), F.asc("expires_at"), F.asc("entry_id")))
    swept = F.col("_due") & (F.col("_dues") <= stop_share * F.col("_cans")) & (F.col("_place") <= F.greatest(F.col("_n") - remain, F.lit(0)))
    return f.withColumn("_place", place).withColumn("swept", swept).drop("_can", "_due", "_n", "_cans", "_dues", "_place")


def reinforced(facts: DataFrame, used: DataFrame, boost: float = 0.05) -> DataFrame:
    """Facts used in a window (used: entry_id) gain `boost`, 1 at most."""
    hit = used.select("entry_id", F.lit(True).alias("_used")).distinct()
    return facts.join(hit, "entry_id", "left").withColumn("importance", F.when(F.col("_used"), F.least(F.lit(1.0), F.col("importance") + boost)).otherwise(F.col("importance"))).drop("_used")


def feedback(facts: DataFrame, votes: DataFrame, step: float = 0.05, floor: float = 0.05) -> DataFrame:
    """votes (entry_id, useful): +step or -step for each, between floor and 1."""
    net = votes.groupBy("entry_id").agg((F.sum(F.when(F.col("useful"), 1).otherwise(-1)) * step).alias("_d"))
    return facts.join(net, "entry_id", "left").withColumn("importance", F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col("importance") + F.coalesce("_d", F.lit(0.0))))).drop("_d")


def tiers(journal: DataFrame, now: int, warm: int = 30, cold: int = 180) -> DataFrame:
    """journal with tier: hot, warm from `warm` days on, cold from `cold` days on; rows still to be judged stay hot."""
    days = (F.lit(now) - F.col("ts")) / DAY
    return journal.withColumn("tier", F.when(F.col("status") == "received", "hot").when(days > cold, "cold").when(days >= warm, "warm").otherwise("hot"))


def dedup_episodes(episodes: DataFrame) -> DataFrame:
    """Of equal summaries of a user the episode with the smallest id."""
    hashed = episodes.withColumn("_h", F.sha2("summary", 256))
    return wn.latest(hashed, ["user_id", "_h"], F.asc("episode_id")).drop("_h")


def never_recalled(facts: DataFrame, recalled: DataFrame, now: int, days: int = 90) -> DataFrame:
    """Stale facts that no recall has touched (recalled: entry_id; nulls are no ids)."""
    return facts.where(F.col("created_at") < now - days * DAY).join(recalled.dropna(subset=["entry_id"]), "entry_id", "left_anti")
