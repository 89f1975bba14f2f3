"""Helpers shared by the operators: inputs, the shared work folder, words, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the controls 0x09 to 0x0D, in Java's regular expressions.
SPACES = "[\\x20\\x09-\\x0D]+"
#: A key is hot from this many rows on, and if it has over one part in HOT_SHARE of all.
HOT_LEAST, HOT_SHARE = 50_000, 10_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir where it is set.

    Only where it is unset and all runs in one process (tests) a folder of our own is made and set;
    on a cluster the executors could not see it, so there an error is raised."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="memspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, computed once here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    df.write.parquet(path := scratch_dir(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, dim: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with dim, in which each key is once, so that no key of very many rows meets in one task.

    Keys with over 1/HOT_SHARE of the rows (and HOT_LEAST rows) are HOT_SHARE at most, so their part of dim is
    broadcast; the rest is a plain join, and so is the whole where there are HOT_LEAST rows at most (total: their number,
    if known). how: inner or left. Null keys match nothing. rows are read several times."""
    total = rows.count() if total is None else total
    if total <= HOT_LEAST:
        return rows.join(dim, key, how)
    n = rows.groupBy(key).count()
    hot = cut(n.filter((F.col("count") > max(HOT_LEAST, total // HOT_SHARE)) & F.col(key).isNotNull()).select(F.col(key).alias("_hot")))
    if hot.isEmpty():
        return rows.join(dim, key, how)
    hot = F.broadcast(hot)
    few = cut(dim.join(hot, F.col(key) == F.col("_hot"), "left_semi"))
    marked = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    often, other = marked.filter("_hot is not null").drop("_hot"), marked.filter("_hot is null").drop("_hot")
    return often.join(F.broadcast(few), key, how).unionByName(other.join(dim, key, how))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text in UTF-8 with A-Z lower-cased; null has none.

    bytes.lower() changes A-Z alone, and bytes.split() parts at 0x20 and 0x09-0x0D."""
    return text.encode().lower().split() if text else []


def held_out(doc_id: Column, parts: int, at: int) -> Column:
    """crc32 of doc_id as text mod parts equals at; a null doc_id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(parts) == F.lit(at), F.lit(False))
