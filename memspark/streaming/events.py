"""Streams of journal and event rows: the same logic as in batch, with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late a row may come; equal to the window in which provenance can still be claimed.
LATE = "15 minutes"


def tail(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpoint keeps the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def session_counts(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each key that end after `gap` without events; `at` is a timestamp."""
    return events.withWatermark(at, LATE).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def rollup(events: DataFrame, at: str = "ts", size: str = "1 hour", *keys: str) -> DataFrame:
    return events.withWatermark(at, LATE).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_ts"), *keys, "n", "total")


def deduplicated(rows: DataFrame, keys: list[str], at: str = "ts", within: str = LATE) -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def claimed(captures: DataFrame, sources: DataFrame) -> DataFrame:
    """Stream-stream join: a source message claims a capture of its text from 1 s before to 900 s after it."""
    c = captures.withWatermark("capture_ts", LATE)
    s = sources.withWatermark("source_ts", LATE)
    return c.join(s, F.expr("capture_hash = source_hash and capture_ts >= source_ts - interval 1 second and capture_ts <= source_ts + interval 900 seconds"))


def adaptive_gate(scores: DataFrame, start: float = 0.4, rate: float = 0.1) -> DataFrame:
    """scores (user_id string, id long, score double): passes or not, against a threshold that each user's scores move."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        threshold = state.get[0] if state.exists else start
        for b in batches:
            out = []
            for i, s in sorted(zip(b["id"], b["score"])):
                out.append((key[0], i, s, threshold, s >= threshold))
                threshold = (1 - rate) * threshold + rate * min(max(s, 0.1), 0.6)
            yield pd.DataFrame(out, columns=["user_id", "id", "score", "threshold", "passes"])
        state.update((threshold,))

    return scores.groupBy("user_id").applyInPandasWithState(step, "user_id string, id long, score double, threshold double, passes boolean", "threshold double", "append", GroupStateTimeout.NoTimeout)
