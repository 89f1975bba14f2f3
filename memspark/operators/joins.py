"""Joins that need more than equal keys: as-of, intervals, symmetric links, set differences."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, stored

#: Members of a group that are joined; of a block of a larger group; groups whose hashes a member carries; members of a batch, each with those it is paired with.
SMALL, BLOCK, CARRIED, ROWS = 64, 2048, 128, 64
#: Rows of a task whose rows are multiplied or sorted.
ROWS_OF_TASK = 100_000
#: Pairs that a task makes; pairs of a row that are made at once.
PAIRS_OF_TASK, EMITTED = 4_000_000, 131_072


def intervals(versions: DataFrame, keys: list[str], at: str = "created_at", tie: str = "entry_id") -> DataFrame:
    """Versions with valid_from and valid_to (when the next version of the key came; null: still valid)."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return versions.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def value_at(history: DataFrame, keys: list[str], at: int) -> DataFrame:
    """The version of each key that is valid at a time: from <= at < to, the latest from."""
    valid = history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    latest = F.max_by(F.struct(*[c for c in history.columns if c not in keys]), F.struct("valid_from", "entry_id"))
    return valid.groupBy(*keys).agg(latest.alias("_v")).select(*keys, "_v.*")


def as_of(probes: DataFrame, versions: DataFrame, keys: list[str], probe_at: str, version_at: str, value: str) -> DataFrame:
    """probes with the value of the last version at or before their time; one sort of both sides, no range join."""
    left = probes.withColumn("_at", F.col(probe_at)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(versions.schema[value].dataType))
    right = versions.select(*keys, F.col(version_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_at", "_side", "_v")


def in_interval(events: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, ident: str = "log_id", bucket: int = 86_400) -> DataFrame:
    """events joined with the span of their keys that holds them, the one that starts last if several do.

    ident names each event. Both sides are cut into time buckets, so this is an equal-key join with a filter."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    e = events.withColumn("_b", F.floor(F.col(at) / bucket))
    met = e.join(s, [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    row = F.struct(*[c for c in met.columns if c not in ("_b", ident)])
    return met.groupBy(ident).agg(F.max_by(row, F.struct(start, end)).alias("_r")).select(ident, "_r.*")


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """node, neighbour and the carried columns for both ends of each edge, so neighbours are found by an equal-key join."""
    a = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), *carry)
    return a.unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), *carry))


def pairs_sharing(items: DataFrame, group: str, member: str, least: int = 1, new: str | None = None, weigh: Callable[[Column], Column] | None = None) -> DataFrame:
    """a < b and n: members that share at least `least` groups, of any size. Rows of items are distinct. weigh: what to give in n's place, worked out for many pairs at once.

    new: a column of the member, a boolean that is true for one of each pair at least, or the number of the batch that it came with (below
    0: before all); then pairs have the greater of both as `batch`, which is 0 at least.

    A pair is made in the least of the groups that it shares (by number) and counted there, as each row carries the numbers of
    its member's groups; so pairs are never shuffled. Members of small groups are joined, those of others meet in pairs of blocks, in as
    many tasks as there are pairs for. Only members of over CARRIED groups don't carry them: their pairs are joined and counted."""
    kind = items.schema[member].dataType.simpleString()
    weighed = F.col("n") if weigh is None else weigh(F.col("n")).alias("n")
    numbers = new is not None and items.schema[new].dataType.simpleString() != "boolean"
    batch = F.col(new).cast("int") if numbers else F.col(new).cast("int") - 1 if new else F.lit(0)
    rows = stored(items.select(F.col(group).alias("_g"), F.col(member).alias("_m"), batch.alias("_new")).where(F.col(group).isNotNull() & F.col(member).isNotNull()))
    sizes = numbered(rows.groupBy("_g").agg(F.count("*").alias("_n"), F.max("_new").alias("_any")).where("_n > 1 and _any >= 0").drop("_any"), "_h")
    largest, made = sizes.agg(F.max("_n"), F.sum(F.when(F.col("_n") > SMALL, F.col("_n").cast("double") * F.col("_n") / 2))).first()
    wide = cut(rows.groupBy("_m").agg(F.count("*").alias("n")).where(F.col("n") > CARRIED).select("_m"))
    some_wide = not wide.isEmpty()
    narrow = rows.join(wide, "_m", "left_anti") if some_wide else rows
    lists = stored(narrow.join(sizes, "_g").groupBy("_m", "_new").agg(F.array_sort(F.collect_list(F.struct("_h", F.col("_n").cast("int").alias("_n")))).alias("_l")))
    held = lists.select("_m", "_new", F.transform("_l", lambda x: x["_h"]).alias("_of"), F.explode("_l").alias("_e")).select("_e.*", "_m", "_new", "_of")
    small = held.where(F.col("_n") <= SMALL) if (largest or 0) > SMALL else held
    of = lambda df, k, *cols: df.select("_h", *[F.col(c).alias(c + k) for c in ("_m", "_new", "_of") if c in df.columns])
    met = of(small, "a").join(of(small, "b"), "_h").where("_ma < _mb and (_newa >= 0 or _newb >= 0)").withColumn("_s", F.array_intersect("_ofa", "_ofb"))
    both = F.greatest("_newa", "_newb").alias("batch")
    found = met.where(F.array_min("_s") == F.col("_h")).select(F.col("_ma").alias("a"), F.col("_mb").alias("b"), F.size("_s").cast("long").alias("n"), both)
    found = found.where(F.col("n") >= least).select("a", "b", weighed, "batch")
    if (largest or 0) > SMALL:
        parts = F.ceil(F.col("_n") / BLOCK).cast("int")
        dealt = held.where(F.col("_n") > SMALL).withColumn("_c", F.pmod(F.xxhash64("_m"), parts).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), parts - 1)))
        cells = dealt.select("_h", "_m", "_new", "_of", "_c", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"))
        cells = in_tasks(cells, made, "_h", "_i", "_j", each=PAIRS_OF_TASK)
        at = cells.groupBy("_h", "_i", "_j").applyInArrow(lambda t: _block_pairs(t, least), f"names array<{kind}>, batches array<int>, n long, at array<int>").select("names", "batches", weighed, "at").select("names", "batches", "n", F.explode("at").alias("_p"))
        one, other = F.shiftright("_p", 16), F.col("_p").bitwiseAND(0xFFFF)
        found = found.unionByName(at.select(F.col("names")[one].alias("a"), F.col("names")[other].alias("b"), "n", F.greatest(F.col("batches")[one], F.col("batches")[other]).alias("batch")))
    if some_wide:
        marked = rows.join(wide.withColumn("_wide", F.lit(True)), "_m", "left")
        one, other = marked.where("_wide"), marked
        met = one.select("_g", F.col("_m").alias("x"), F.col("_new").alias("nx")).join(other.select("_g", F.col("_m").alias("y"), F.col("_new").alias("ny"), "_wide"), "_g")
        met = met.where("(nx >= 0 or ny >= 0) and (x < y or x > y and _wide is null)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.greatest("nx", "ny").alias("batch"))
        found = found.unionByName(met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("batch").alias("batch")).where(F.col("n") >= least).select("a", "b", weighed, "batch"))
    return found if numbers else found.drop("batch")


def _block_pairs(t: pa.Table, least: int) -> pa.Table:
    """Of blocks _i and _j of the members of one group the pairs whose least shared group this is: n and the places of a and b in names, 16 bits each."""
    i, j, own = t["_i"][0].as_py(), t["_j"][0].as_py(), t["_h"][0].as_py()
    t = t.select(["_m", "_new", "_of", "_c"]).combine_chunks().sort_by("_m")
    block, new = t["_c"].to_numpy(), t["_new"].to_numpy()
    left, right = (np.flatnonzero(block == k).astype(np.int32) for k in (i, j))
    lists = t["_of"].combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(t)), pc.list_value_length(lists).to_numpy())
    n = np.ones((len(left), len(right)), np.uint8 if CARRIED < 255 else np.int32)
    sides = []
    for side in (left, right):
        at = np.full(len(t), -1)
        at[side] = np.arange(len(side))
        mine = (at[owner] >= 0) & (values != own)
        v, k = values[mine], at[owner[mine]]
        order = np.argsort(v, kind="stable")
        names, starts = np.unique(v[order], return_index=True)
        sides.append((names, np.append(starts, len(v)), k[order]))
    (na, sa, ka), (nb, sb, kb) = sides
    both, pa_, pb_ = np.intersect1d(na, nb, assume_unique=True, return_indices=True)
    # Zero: made in a lesser group. Groups come in their order, so all later ones are counted after that.
    later = both > own
    for x, y in zip(pa_[later].tolist(), pb_[later].tolist()):
        n[np.ix_(ka[sa[x] : sa[x + 1]], kb[sb[y] : sb[y + 1]])] += 1
    for x, y in zip(pa_[~later].tolist(), pb_[~later].tolist()):
        n[np.ix_(ka[sa[x] : sa[x + 1]], kb[sb[y] : sb[y + 1]])] = 0
    if new.min() < 0:
        n[np.ix_(new[left] < 0, new[right] < 0)] = 0
    # Within a block each pair is there twice; between two the smaller member may be on either side.
    if i == j:
        n[left[:, None] >= right] = 0
    names, batches, out = t["_m"].combine_chunks(), t["_new"].combine_chunks(), []
    places = np.minimum(left[:, None], right) << 16 | np.maximum(left[:, None], right)
    for v in range(max(least, 1), int(n.max(initial=0)) + 1):
        at = places[n == v]
        out += [(v, at[k : k + EMITTED]) for k in range(0, len(at), EMITTED)]
    kind = pa.schema([("names", pa.list_(names.type)), ("batches", pa.list_(pa.int32())), ("n", pa.int64()), ("at", pa.list_(pa.int32()))])
    return pa.Table.from_batches([_row(kind, names, batches, *some) for some in out], kind)


def _row(kind: pa.Schema, names: pa.Array, batches: pa.Array, n: int, at: np.ndarray) -> pa.RecordBatch:
    """One row of pairs with the names of their members, of all where most are there."""
    if 4 * len(at) < len(names):
        held, places = np.unique(np.concatenate([at >> 16, at & 0xFFFF]), return_inverse=True)
        names, batches, at = names.take(pa.array(held)), batches.take(pa.array(held)), (places[: len(at)] << 16 | places[len(at) :]).astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([listed(names), listed(batches), pa.array([n], pa.int64()), listed(pa.array(at, pa.int32()))], schema=kind)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column of whole numbers from 0 on, in the order of its partitions and rows."""
    dealt = cut(df)
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))]).tolist()
    start = F.element_at(F.array(*map(F.lit, starts)), F.spark_partition_id() + 1)
    return cut(dealt.select("*", (start + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).cast("int").alias(name)))


def in_tasks(df: DataFrame, rows: float, *keys: str, each: int = ROWS_OF_TASK) -> DataFrame:
    """df dealt out by keys to as many tasks as so many rows ask for, so what a task holds doesn't grow with the input."""
    return df.repartition(max(1, math.ceil(rows / each)), *keys)


def in_blocks(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _i and _j, so that each two rows of equal keys meet in one cell (keys, _i, _j) of about `most` rows of each side at most.

    Rows with a null key are left out. Only keys of more than one block are looked up: fewer than rows / most, so they are broadcast."""
    there = lambda df: df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    n = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    many = F.broadcast(cut(n(there(left), "_nl").join(n(there(right), "_nr"), keys).where("_nl > 1 or _nr > 1")))

    def dealt(df: DataFrame, mine: str, n_mine: str, other: str, n_other: str) -> DataFrame:
        met = there(df).join(many, keys, "left")
        block = F.pmod(F.xxhash64(*df.columns), F.coalesce(n_mine, F.lit(1))).cast("int")
        # Named anew, as both sides may come from one table.
        return met.select(*[F.col(c).alias(c) for c in df.columns], block.alias(mine), F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1)).alias(other))

    return dealt(left, "_i", "_nl", "_j", "_nr"), dealt(right, "_j", "_nr", "_i", "_nl")


def bitmaps(lists: pa.ListArray, names: pa.Array) -> np.ndarray:
    """For each of the names a row of bits (bytes, the first row of lists the highest bit): the lists that hold it; at last a row of zeros."""
    owner, at = pc.list_parent_indices(lists).to_numpy(), pc.index_in(lists.flatten(), value_set=names)
    held = at.is_valid().to_numpy(zero_copy_only=False)
    rows, owner = at.drop_null().to_numpy(), owner[held]
    out = np.zeros((len(names) + 1, (len(lists) + 7) // 8), np.uint8)
    np.bitwise_or.at(out, (rows, owner >> 3), (128 >> (owner & 7)).astype(np.uint8))
    return out


def compare(base: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, state (added, removed, changed, same) of other against base, by a full join."""
    b, o = base.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), other.select(*keys, F.col(value).alias("_o"), F.lit(True).alias("_in_o"))
    state = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_o").isNull(), "removed").when(F.col("_b").eqNullSafe(F.col("_o")), "same").otherwise("changed")
    return b.join(o, keys, "full").select(*keys, state.alias("state"))
