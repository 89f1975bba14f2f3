"""Standing queries: named filters that are kept as JSON lines and run again, and lists of nodes by type or tag."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import query_memory

#: What a standing query may ask for: the filter language but for the user, who is named when it runs.
FILTERS = {p for p in inspect.signature(query_memory).parameters if p not in ("df", "user_id")}
_SCHEMA = "name string, version long, spec string"


def checked(name: str, spec: Mapping[str, Any]) -> dict[str, Any]:
    """spec as a dict; an error for names other than 1 to 100 letters, digits, - and _ and for filters that aren't known."""
    if not re.fullmatch(r"(?=.*[^\W_])[\w-]{1,100}", name):
        raise ValueError(f"invalid name of a standing query: {name!r}")
    if unknown := set(spec) - FILTERS - {"description"}:
        raise ValueError(f"standing query {name!r} has unknown filters: {sorted(unknown)}")
    return dict(spec)


def save(spark: SparkSession, folder: str, name: str, spec: Mapping[str, Any]) -> None:
    """Adds a version of the query; the last one counts."""
    version = 1 + (_all(spark, folder).where(F.col("name") == name).agg(F.max("version")).first()[0] or 0)
    spark.createDataFrame([(name, version, json.dumps(checked(name, spec)))], _SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/standing")


def _all(spark: SparkSession, folder: str) -> DataFrame:
    spark.createDataFrame([], _SCHEMA).write.mode("append").json(f"{folder}/standing")
    return spark.read.schema(_SCHEMA).json(f"{folder}/standing")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """name and description of all standing queries (empty where none is given)."""
    last = _all(spark, folder).groupBy("name").agg(F.max_by("spec", "version").alias("spec"))
    return last.select("name", F.coalesce(F.get_json_object("spec", "$.description"), F.lit("")).alias("description"))


def run(spark: SparkSession, folder: str, name: str, tables: Mapping[str, DataFrame], user_id: str = "") -> DataFrame:
    """The rows that the query finds for a user (empty: all) in its source, one of tables (core, episodes)."""
    row = _all(spark, folder).where(F.col("name") == name).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"unknown standing query: {name!r}")
    spec = checked(name, json.loads(row.spec))
    spec.pop("description", None)
    source = spec.get("source", "core")
    if source not in tables:
        raise ValueError(f"standing query {name!r} asks for {source!r}, which isn't given")
    return query_memory(tables[source], **spec, user_id=user_id)


def nodes_of_type(nodes: DataFrame, user_id: str, node_type: str, limit: int = 20) -> DataFrame:
    """A user's nodes of a type, the most confident first, ties by id."""
    return nodes.where((F.col("user_id") == user_id) & (F.col("node_type") == node_type)).orderBy(F.desc("confidence"), "node_id").limit(limit)


def nodes_tagged(nodes: DataFrame, tags: DataFrame, user_id: str, tag: str, limit: int = 20) -> DataFrame:
    """A user's nodes with a tag (tags: node_id, tag), the most confident first, ties by id."""
    return nodes.where(F.col("user_id") == user_id).join(tags.where(F.col("tag") == tag), "node_id", "left_semi").orderBy(F.desc("confidence"), "node_id").limit(limit)
