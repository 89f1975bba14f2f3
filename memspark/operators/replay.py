"""Replay of journal rows under a gate's configuration: claims with leases, verdicts that count once.

The ledger is a table that only grows: a claim says which run works on a row until when, a verdict what came of it. A
row is open for a gate and configuration if it has no verdict that counts and no lease that runs. A verdict counts if its run holds the
latest claim of the row, so a run that was lost and comes back late can't overrule the one that took over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

LEASE = 600
SCHEMA = "kind string, gate string, config string, row_id long, run_id string, at long, verdict string"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger below folder (create it with an empty append)."""
    return spark.read.schema(SCHEMA).parquet(folder)


def append(rows: DataFrame, folder: str) -> None:
    """Adds rows; a Spark write is seen as a whole or not at all."""
    rows.select([F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]).write.mode("append").parquet(folder)


def holders(log: DataFrame, gate: str, config: str) -> DataFrame:
    """row_id, run_id and at of the latest claim of each row (of one time: the largest run)."""
    mine = log.where((F.col("kind") == "claim") & (F.col("gate") == gate) & (F.col("config") == config))
    return mine.groupBy("row_id").agg(F.max(F.struct("at", "run_id")).alias("c")).select("row_id", "c.run_id", "c.at")


def verdicts(log: DataFrame, gate: str, config: str) -> DataFrame:
    """row_id, verdict and run_id: one for each judged row, that of its latest holder; of several the first by time."""
    given = log.where((F.col("kind") == "verdict") & (F.col("gate") == gate) & (F.col("config") == config))
    held = holders(log, gate, config).select("row_id", "run_id")
    return given.join(held, ["row_id", "run_id"]).groupBy("row_id").agg(F.min(F.struct("at", "verdict", "run_id")).alias("v")).select("row_id", "v.verdict", "v.run_id")


def open_rows(journal: DataFrame, log: DataFrame, gate: str, config: str, now: int, since: int = 0, lease: int = LEASE) -> DataFrame:
    """Rows of the journal (id, ts, status, raw_type) that a run may take: received or gated out since a time, no rows of
    the service, no verdict that counts, no lease that runs."""
    wanted = journal.where(F.col("status").isin("received", "gated_out") & (F.col("ts") >= since) & (F.coalesce("raw_type", F.lit("")) != "service"))
    done = verdicts(log, gate, config).select(F.col("row_id").alias("id"))
    busy = holders(log, gate, config).where(F.col("at") + lease > now).select(F.col("row_id").alias("id"))
    return wanted.join(done.unionByName(busy).distinct(), "id", "left_anti")


def claim(spark: SparkSession, folder: str, journal: DataFrame, gate: str, config: str, run_id: str, now: int, most: int | None = None, since: int = 0, lease: int = LEASE) -> DataFrame:
    """Claims the open rows (the `most` oldest, if given) for a run; returns those that are its own afterwards.

    Runs that claim at the same time see each other's claims when they read again; the latest holds the row."""
    found = open_rows(journal, ledger(spark, folder), gate, config, now, since, lease)
    taken = cut((found.orderBy("ts", "id").limit(most) if most else found).select("id"))
    append(taken.select(F.lit("claim").alias("kind"), F.lit(gate).alias("gate"), F.lit(config).alias("config"), F.col("id").alias("row_id"), F.lit(run_id).alias("run_id"), F.lit(now).alias("at"), F.lit(None).alias("verdict")), folder)
    mine = holders(ledger(spark, folder), gate, config).where(F.col("run_id") == run_id).select(F.col("row_id").alias("id"))
    return journal.join(taken, "id", "left_semi").join(mine, "id", "left_semi")


def record(judged: DataFrame, folder: str, gate: str, config: str, run_id: str, now: int) -> None:
    """judged (id, verdict): adds the run's verdicts. Done twice they count once."""
    append(judged.select(F.lit("verdict").alias("kind"), F.lit(gate).alias("gate"), F.lit(config).alias("config"), F.col("id").alias("row_id"), F.lit(run_id).alias("run_id"), F.lit(now).alias("at"), "verdict"), folder)


def applied(journal: DataFrame, log: DataFrame, gate: str, config: str) -> DataFrame:
    """The journal with the status that the verdicts that count give its rows."""
    v = verdicts(log, gate, config).select(F.col("row_id").alias("id"), F.col("verdict").alias("_v"))
    return journal.join(v, "id", "left").withColumn("status", F.coalesce("_v", "status")).drop("_v")
