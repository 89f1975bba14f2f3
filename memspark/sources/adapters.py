"""Memory-shaped tables from the tables at hand. Times are whole epoch seconds (UTC).

Each function returns a lazy DataFrame with just the columns of its entity, so scans stay
narrow; SQL holds the same derivations for DuckDB, as named subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-02-01 00:00:00 UTC; operators take their clock as an argument, queries use this one.
NOW = 1_706_745_600
DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def journal(spark: SparkSession, d: str) -> DataFrame:
    """One row per conversation turn: id, ts, layer, user_id, text, raw_type."""
    return journal_of(table(spark, d, "conversations"))


def journal_of(c: DataFrame) -> DataFrame:
    """Journal rows of conversation turns, a table or a stream."""
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        (F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
        F.when(F.col("role") == "assistant", "agent").otherwise("user").alias("layer"),
        F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"),
        "text",
        F.when(F.col("role") == "system", "service").otherwise("message").alias("raw_type"),
    )


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Every saved version of a fact: entry_id, user_id, key, value, importance, memory_kind, created_at."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    kind = F.create_map(*[F.lit(x) for x in ("BUILDING", "fact", "AUTOMOBILE", "preference", "MACHINERY", "procedural", "HOUSEHOLD", "goal", "FURNITURE", "observation")])
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("entry_id"),
        F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("user_id"),
        F.col("c_name").alias("key"),
        F.col("o_orderpriority").alias("value"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("importance"),
        F.coalesce(kind[F.col("c_mktsegment")], F.lit("fact")).alias("memory_kind"),
        seconds("o_orderdate").alias("created_at"),
    )


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """episode_id, user_id, summary, weight, tags, created_at."""
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("episode_id"),
        F.col("lang").alias("user_id"),
        F.col("text").alias("summary"),
        F.coalesce(F.col("quality") * 0.6 + F.col("toxic") * 0.3, F.lit(0.5)).alias("weight"),
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source")).alias("tags"),
        (F.lit(NOW) - F.col("doc_id") * 3600).alias("created_at"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """node_id, layer, content, node_type: suppliers and parts."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit("user").alias("layer"), F.col("s_name").alias("content"), F.lit("supplier").alias("node_type"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("user").alias("layer"), F.col("p_name").alias("content"), F.lower("p_type").alias("node_type"))
    return s.unionByName(p)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source_id, target_id, relation, weight, created_at, valid_from, valid_to: what a supplier ships."""
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_shipdate")
    pair = line.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_discount"), 2).alias("w"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"), F.count("*").alias("n"))
    return pair.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"),
        F.lit("supplies").alias("relation"),
        F.least(F.lit(1.0), F.col("w") + 0.1).alias("weight"),
        seconds("a").alias("created_at"),
        seconds("a").alias("valid_from"),
        F.when(F.col("n") > 1, seconds("b")).alias("valid_to"),
    )


def tags(spark: SparkSession, d: str) -> DataFrame:
    """node_id, tag: a part's size and its line (40 parts that follow one another)."""
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.array(F.concat(F.lit("size:"), F.col("p_size").cast("string")), F.concat(F.lit("line:"), F.floor(F.col("p_partkey") / 40).cast("string"))).alias("tags"))
    return p.select("node_id", F.explode("tags").alias("tag"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    """log_id, user_id, action, target_id (text), ts, value."""
    return table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.col("user_id"), F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("target_id"), seconds("ts").alias("ts"), "value")


def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    """from_path, to_path: anchors of each page, both named by the page's first path word."""
    p = table(spark, d, "pages").select(F.concat(F.lit("/page"), F.col("page_id").cast("string")).alias("from_path"), F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1).alias("to"))
    return p.select("from_path", F.explode(F.array_distinct("to")).alias("to_path"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


SQL = {
    "journal": "journal AS (SELECT conv_id * 1000 + turn AS id, conv_id * 3600 + turn * 60 AS ts, CASE WHEN role = 'assistant' THEN 'agent' ELSE 'user' END AS layer, 'u' || (conv_id % 7)::varchar AS user_id, text, CASE WHEN role = 'system' THEN 'service' ELSE 'message' END AS raw_type FROM conversations)",
    "facts": "facts AS (SELECT o_orderkey AS entry_id, 'u' || c_nationkey::varchar AS user_id, c_name AS key, o_orderpriority AS value, (c_acctbal + 1000) / 11000 AS importance, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'preference' WHEN 'MACHINERY' THEN 'procedural' WHEN 'HOUSEHOLD' THEN 'goal' WHEN 'FURNITURE' THEN 'observation' ELSE 'fact' END AS memory_kind, epoch(o_orderdate)::bigint AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)",
    "episodes": f"episodes AS (SELECT d.doc_id AS episode_id, lang AS user_id, text AS summary, coalesce(quality * 0.6::double + toxic * 0.3::double, 0.5::double) AS weight, ['lang:' || lang, 'src:' || source] AS tags, {NOW} - d.doc_id * 3600 AS created_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    "nodes": "nodes AS (SELECT 's' || s_suppkey::varchar AS node_id, 'user' AS layer, s_name AS content, 'supplier' AS node_type FROM supplier UNION ALL SELECT 'p' || p_partkey::varchar, 'user', p_name, lower(p_type) FROM part)",
    "edges": "edges AS (SELECT 's' || l_suppkey::varchar AS source_id, 'p' || l_partkey::varchar AS target_id, 'supplies' AS relation, least(1.0::double, round(sum(l_discount), 2) + 0.1::double) AS weight, epoch(min(l_shipdate))::bigint AS created_at, epoch(min(l_shipdate))::bigint AS valid_from, CASE WHEN count(*) > 1 THEN epoch(max(l_shipdate))::bigint END AS valid_to FROM lineitem GROUP BY l_suppkey, l_partkey)",
    "tags": "tags AS (SELECT DISTINCT 'p' || p_partkey::varchar AS node_id, unnest(['size:' || p_size::varchar, 'line:' || (p_partkey // 40)::varchar]) AS tag FROM part)",
    "audit": "audit AS (SELECT event_id AS log_id, user_id, event_type AS action, json_extract_string(props, '$.k') AS target_id, floor(epoch(ts))::bigint AS ts, value FROM events)",
    "wiki_links": "wiki_links AS (SELECT '/page' || page_id::varchar AS from_path, unnest(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))) AS to_path FROM pages)",
}


def with_sql(body: str, *names: str, recursive: bool = False) -> str:
    """body, preceded by the named subqueries; further ones may open it with a comma."""
    from ..functions.policy import kinds_sql

    parts = [kinds_sql() if n == "kinds" else SQL[n] for n in names]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}{body}"
