"""Branches, snapshots, exports and imports, cursors, caches of vectors, identity chunks and shortened logs."""

from __future__ import annotations

import hashlib
import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import joins as jn

# Words that make a line of a log worth keeping.
LOG_WORDS = ["error", "warn", "fail", "fatal", "critical", "panic", "exception", "traceback", "assert", "ошибка", "падает", "сбой"]


# -- branches and snapshots ---------------------------------------------------------------


def create_branch(facts: DataFrame, base: str, user_id: str, name: str) -> DataFrame:
    """facts (layer, user_id, ...) with the base layer's rows of a user once more, in the layer base@name."""
    return facts.unionByName(facts.where((F.col("layer") == base) & (F.col("user_id") == user_id)).withColumn("layer", F.lit(f"{base}@{name}")))


def branches(facts: DataFrame) -> DataFrame:
    return facts.where(F.contains("layer", F.lit("@"))).groupBy("layer").agg(F.count("*").alias("n"))


def merge_branch(facts: DataFrame, base: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """The base layer's rows (user_id, key, value) after taking over those keys of the branch that differ (all, or the ones listed)."""
    b, m = (facts.where(F.col("layer") == x).select("user_id", "key", "value") for x in (f"{base}@{name}", base))
    state = jn.compare(m, b, ["user_id", "key"], "value").where(F.col("state").isin("added", "changed"))
    wanted = (state if keys is None else state.where(F.col("key").isin(*keys))).select("user_id", "key")
    taken = b.join(wanted, ["user_id", "key"], "left_semi")
    return m.join(taken.select("user_id", "key"), ["user_id", "key"], "left_anti").unionByName(taken)


def delete_branch(facts: DataFrame, base: str, name: str) -> DataFrame:
    return facts.where(F.col("layer") != f"{base}@{name}")


def snapshot(facts: DataFrame, keys: list[str], name: str, at: int) -> DataFrame:
    """One row per fact of a named snapshot: name, at, the keys and the row as JSON. Append it to the store of snapshots."""
    return facts.select(F.lit(name).alias("name"), F.lit(at).alias("at"), *keys, F.to_json(F.struct(*facts.columns)).alias("row"))


def from_snapshot(store: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows of a snapshot's latest state, as they were."""
    mine = store.where(F.col("name") == name)
    last = mine.agg(F.max("at").alias("_at"))
    return mine.join(F.broadcast(last), F.col("at") == F.col("_at")).select(F.from_json("row", schema).alias("r")).select("r.*")


# -- exports and imports ------------------------------------------------------------------


def export_parts(df: DataFrame, path: str, part: Column, name: str) -> None:
    """JSON lines in one folder for each value of part (a kind, a month)."""
    df.withColumn(name, part).write.mode("overwrite").partitionBy(name).json(path)


def import_new(spark: SparkSession, path: str, schema: str, current: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON lines against what is there: the rows to add (of each key the least by all columns), and one row of counts: read, added, skipped."""
    read = spark.read.schema(schema).json(path)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*read.columns))
    once = read.withColumn("_n", place).where("_n = 1").drop("_n").join(current.select(*keys), keys, "left_anti")
    return once, read.agg(F.count("*").alias("read")).crossJoin(once.agg(F.count("*").alias("added"))).withColumn("skipped", F.col("read") - F.col("added"))


def archive_and_prune(log: DataFrame, path: str, before: Column) -> DataFrame:
    """Writes the rows before a time as JSON lines and returns the others."""
    log.where(before).write.mode("overwrite").json(path)
    return log.where(~before)


# -- cursors ------------------------------------------------------------------------------


def fetch_after(source: DataFrame, cursor: str, last: int, limit: int, only: Column | None = None) -> DataFrame:
    """The next rows of a growing table, in order of its cursor."""
    rows = source.where(F.col(cursor) > last)
    return (rows if only is None else rows.where(only)).orderBy(cursor).limit(limit)


def latest(source: DataFrame, cursor: str) -> DataFrame:
    """One row: the cursor to start from when only what comes later counts (0 for an empty table)."""
    return source.agg(F.coalesce(F.max(cursor), F.lit(0)).alias("cursor"))


# -- vectors ------------------------------------------------------------------------------


def normal_text(text: Column) -> Column:
    """Lower case, without marks, blanks made one: what equal texts of the cache share."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), "[^\\pL\\pN_\\s]", ""), "\\s+", " ")


def cached(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """texts with text_hash and the cached embedding of that model (null: not there yet)."""
    mine = cache.where(F.col("model") == model).select("text_hash", "embedding").dropDuplicates(["text_hash"])
    return texts.withColumn("text_hash", F.sha2(normal_text(F.col(text)), 256)).join(mine, "text_hash", "left")


def hash_vector(text: str | None, dim: int = 384) -> list[float]:
    """A vector from a text's SHA-512: its bytes as numbers, those that are finite, then zeros, of unit length."""
    raw = hashlib.sha512((text or "").lower().encode()).digest()
    found = [x for (x,) in struct.iter_unpack("<f", raw) if math.isfinite(x)][:dim]
    size = math.sqrt(sum(x * x for x in found)) or 1.0
    return [x / size for x in found] + [0.0] * (dim - len(found))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    return texts.map(hash_vector, na_action=None)


# -- texts --------------------------------------------------------------------------------


def shortened_log(text: Column, most: int = 50) -> Column:
    """The first line and those that tell of trouble, repeats in a row once, `most` lines and then how many more there were."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")
    bad = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.lower(x).rlike("|".join(LOG_WORDS)))
    first = F.when(F.trim(lines[0]) != "", F.array(lines[0])).otherwise(F.array().cast("array<string>"))
    every = F.concat(first, bad)
    kept = F.filter(every, lambda x, i: (i == 0) | (x != F.get(every, i - 1)) | ((i == 1) & (F.size(first) == 0)))
    more = F.concat(F.lit("... truncated, "), (F.size(kept) - most).cast("string"), F.lit(" more error lines"))
    return F.when(F.size(kept) > most, F.concat_ws("\n", F.slice(kept, 1, most), more)).otherwise(F.array_join(kept, "\n"))


def identity_chunks(pages: DataFrame, ident: str, text: str, least: int = 30) -> DataFrame:
    """A Markdown text cut before each heading of the second level: ident, heading (the first line), chunk; short ones are left out."""
    parts = F.filter(F.transform(F.split(F.col(text), "(?m)^(?=## )"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)
    c = pages.select(ident, F.posexplode(parts).alias("place", "chunk"))
    head = F.trim(F.regexp_replace(F.substring_index("chunk", "\n", 1), "^#+|#+$", ""))
    return c.select(ident, "place", F.when(head == "", "_top").otherwise(head).alias("heading"), "chunk")
