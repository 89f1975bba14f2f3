"""Typed-memory policy: what each kind of memory is worth, how fast it fades, and where it belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kind, default importance, decay per day, never archived, needs an expiry, retrieval priority.
KINDS = [
    ("instruction", 0.9, 0.0, True, False, 0.85),
    ("fact", 0.5, 0.01, False, False, 0.9),
    ("decision", 0.7, 0.005, False, False, 0.9),
    ("goal", 0.8, 0.005, False, True, 0.8),
    ("preference", 0.7, 0.003, False, False, 0.6),
    ("commitment", 0.85, 0.0, True, True, 0.8),
    ("relationship", 0.6, 0.002, False, False, 0.7),
    ("observation", 0.4, 0.02, False, False, 0.3),
    ("rule", 0.85, 0.0, True, False, 0.9),
    ("todo", 0.6, 0.005, False, True, 0.6),
    ("question", 0.5, 0.05, False, False, 0.3),
    ("hypothesis", 0.45, 0.03, False, False, 0.4),
    ("context", 0.3, 0.05, False, False, 0.1),
    ("procedural", 0.8, 0.0, True, False, 0.8),
]
KINDS_SCHEMA = "memory_kind string, default_importance double, decay_rate double, never_archive boolean, needs_expiry boolean, priority double"


def kinds(spark: SparkSession) -> DataFrame:
    """The policy dimension; 14 rows, so joins broadcast it."""
    return F.broadcast(spark.createDataFrame(KINDS, KINDS_SCHEMA))


def kinds_sql() -> str:
    rows = ", ".join(f"('{k}', {i}, {d}, {str(n).lower()}, {str(e).lower()}, {p})" for k, i, d, n, e, p in KINDS)
    return f"kinds AS (SELECT k AS memory_kind, i::double AS default_importance, d::double AS decay_rate, n AS never_archive, e AS needs_expiry, p::double AS priority FROM (VALUES {rows}) t(k, i, d, n, e, p))"


def decayed(importance: Column, rate: Column, days: Column) -> Column:
    """Importance after days without an update, 0.01 at least; kinds without decay keep theirs."""
    return F.when(rate == 0, importance).otherwise(F.greatest(F.lit(0.01), importance * F.exp(-rate * days)))


def kind_weight(kind: Column) -> Column:
    """Facts that steer behaviour count a little more in retrieval."""
    return F.when(kind.isin("instruction", "rule", "commitment"), 1.1).otherwise(1.0)
