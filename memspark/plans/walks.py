"""Named queries of the miners, conversations and files, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import conversation as cv
from ..operators import joins as jn
from ..operators import miners as mn
from ..operators import windows as wn
from ..sources import adapters as ad
from ..sources import files as fs
from ..sources.adapters import NOW, with_sql
from .queries import query

_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\pL\\pN]+'), lambda x: length(x) >= {n}))"
MARKER = "hand|that"


@query("led_to_edges", with_sql(f""", k AS (SELECT id, ts, regexp_matches(text, '{MARKER}') AS marked, unnest({_WORDS.format(c="text", n=4)}) AS token FROM journal)
SELECT DISTINCT a.id AS source_id, b.id AS target_id, 0.3::double AS weight FROM k a JOIN k b ON a.token = b.token WHERE b.marked AND b.ts - a.ts BETWEEN 300 AND 2592000""", "journal"))
def led_to_edges(spark: SparkSession, d: str) -> DataFrame:
    j = ad.journal(spark, d).select(F.col("id").alias("node_id"), F.col("text").alias("content"), F.col("ts").alias("created_at"))
    return mn.led_to(j, MARKER).drop("relation")


#: Copies of every fifth part, without an edge.
_LONE = "nt AS (SELECT * FROM nodes UNION ALL SELECT 'x' || p_partkey::varchar, 'user', p_name, lower(p_type) FROM part WHERE p_partkey % 5 = 0)"


def _with_lone(spark: SparkSession, d: str) -> DataFrame:
    p = ad.table(spark, d, "part").where("p_partkey % 5 = 0")
    return ad.nodes(spark, d).unionByName(p.select(F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("user").alias("layer"), F.col("p_name").alias("content"), F.lower("p_type").alias("node_type")))


@query("dream_bridges", with_sql(f""", {_LONE}, s AS (SELECT node_id, {_WORDS.format(c="content", n=3)} AS w FROM nt), e AS (SELECT * FROM edges),
iso AS (SELECT * FROM s WHERE len(w) > 0 AND node_id NOT IN (SELECT source_id FROM e) AND node_id NOT IN (SELECT target_id FROM e)),
p AS (SELECT a.node_id AS a, b.node_id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS sim FROM iso a JOIN s b ON a.node_id <> b.node_id AND len(b.w) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM p WHERE sim >= 0.7)
SELECT DISTINCT least(a, b) AS source_id, greatest(a, b) AS target_id, round(sim * 0.3, 6) AS weight FROM r WHERE n = 1""", "nodes", "edges"))
def dream_bridges(spark: SparkSession, d: str) -> DataFrame:
    found = mn.bridges(_with_lone(spark, d), ad.edges(spark, d))
    return found.select("source_id", "target_id", F.round("weight", 6).alias("weight"))


def _sql_rounds(rounds: int) -> str:
    out = ", l0 AS (SELECT node, node AS community FROM own)"
    for k in range(1, rounds + 1):
        out += f""", v{k} AS (SELECT k.node, community, round(sum(k.weight), 6) AS votes FROM k JOIN l{k - 1} l ON l.node = k.neighbour GROUP BY ALL),
l{k} AS (SELECT node, community FROM v{k} QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, community) = 1)"""
    return out + f" SELECT * FROM l{rounds}"


@query("graph_communities", with_sql(f""", b AS (SELECT source_id AS node, target_id AS neighbour, weight FROM edges UNION ALL SELECT target_id, source_id, weight FROM edges),
own AS (SELECT node, node AS neighbour, max(weight) AS weight FROM b GROUP BY node), k AS (SELECT node, neighbour, max(weight) AS weight FROM b GROUP BY ALL UNION ALL SELECT * FROM own){_sql_rounds(3)}""", "edges"))
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return mn.communities(ad.edges(spark, d), 3)


def _causes(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders, their suppliers, nations and regions as causes."""
    line = ad.table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_discount").alias("w"))
    a = line.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_id"), F.lit("caused").alias("relation"), F.col("w").alias("weight"))
    s = ad.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("led_to"), F.lit(0.5))
    n = ad.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit("prevented"), F.lit(0.25))
    return a.union(s).union(n)


@query("causal_trace", """WITH e AS (SELECT 'o' || l_orderkey::varchar AS a, 's' || l_suppkey::varchar AS b, 'caused' AS relation, max(l_discount) AS weight FROM lineitem GROUP BY ALL
UNION ALL SELECT 's' || s_suppkey::varchar, 'n' || s_nationkey::varchar, 'led_to', 0.5 FROM supplier UNION ALL SELECT 'n' || n_nationkey::varchar, 'r' || n_regionkey::varchar, 'prevented', 0.25 FROM nation),
f0 AS (SELECT 'o' || o_orderkey::varchar AS root, 'o' || o_orderkey::varchar AS node FROM orders WHERE o_orderpriority = '1-URGENT'),
f1 AS (SELECT root, b AS node, max(relation) AS relation, max(weight) AS weight, 1 AS depth FROM f0 JOIN e ON a = node GROUP BY root, b),
f2 AS (SELECT root, b AS node, max(e.relation) AS relation, max(e.weight) AS weight, 2 AS depth FROM f1 JOIN e ON a = node GROUP BY root, b),
f3 AS (SELECT root, b AS node, max(e.relation) AS relation, max(e.weight) AS weight, 3 AS depth FROM f2 JOIN e ON a = node GROUP BY root, b)
SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3""")
def causal_trace(spark: SparkSession, d: str) -> DataFrame:
    roots = ad.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return mn.trace(_causes(spark, d), roots, 3)


@query("mermaid_drawing", with_sql(""", c AS (SELECT * FROM nodes ORDER BY node_id LIMIT 50),
l AS (SELECT 0 AS part, node_id AS k, '' AS k2, '  ' || node_id || '["' || trim(translate(substr(content, 1, 60) || ' (' || node_type || ')', '"' || chr(10), ''' ')) || '"]' AS line FROM c
UNION ALL SELECT 1, source_id, target_id, '  ' || source_id || ' -->|' || relation || '| ' || target_id FROM edges WHERE source_id IN (SELECT node_id FROM c) AND target_id IN (SELECT node_id FROM c))
SELECT 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY part, k, k2, line) AS text FROM l""", "nodes", "edges"))
def mermaid_drawing(spark: SparkSession, d: str) -> DataFrame:
    return mn.mermaid(ad.nodes(spark, d), ad.edges(spark, d))


def _sql_grams(c: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) - {n - 2}), lambda i: substr(lower({c}), i, {n})))"


def _sql_alike(a: str, b: str) -> str:
    """similarity() of texts under 80 characters."""
    one = lambda n: f"(CASE WHEN length({a}) < {n} AND length({b}) < {n} THEN 0 ELSE len(list_intersect({_sql_grams(a, n)}, {_sql_grams(b, n)})) / len(list_distinct(list_concat({_sql_grams(a, n)}, {_sql_grams(b, n)}))) END)"
    return f"({one(3)} + {one(4)}) / 2"


@query("similar_twins", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round({_sql_alike('a.p_name', 'b.p_name')}, 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE {_sql_alike('a.p_name', 'b.p_name')} > 0.3")
def similar_twins(spark: SparkSession, d: str) -> DataFrame:
    p = ad.table(spark, d, "part").select("p_brand", "p_size", F.col("p_partkey").alias("id"), F.col("p_name").alias("content"))
    return mn.twins(p, ["p_brand", "p_size"]).select("a", "b", F.round("similarity", 6).alias("similarity"))


_PART_TEXT = "p_name || ' ' || p_type"


@query("fact_conflicts", f"""WITH p AS (SELECT p_partkey AS id, p_brand AS brand, p_size, {_PART_TEXT} AS t, list_filter(string_split_regex(lower({_PART_TEXT}), '\\s+'), lambda w: length(w) > 3) AS w FROM part),
m AS (SELECT s.id AS save_id, f.id AS entry_id, s.brand, s.t AS new, f.t AS old FROM p s JOIN p f ON s.brand = f.brand AND s.p_size > 25 AND f.p_size <= 25 AND len(list_intersect(s.w[1:5], f.w)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY save_id ORDER BY entry_id) AS n FROM m QUALIFY n <= 5),
x AS (SELECT *, {_sql_alike('new', 'old')} AS similarity FROM r WHERE new <> old)
SELECT brand, save_id, entry_id, round(similarity, 6) AS similarity FROM x WHERE similarity > 0.3 QUALIFY row_number() OVER (PARTITION BY save_id ORDER BY n) = 1""")
def fact_conflicts(spark: SparkSession, d: str) -> DataFrame:
    p = ad.table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_size", "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("content"))
    found = mn.conflicts(p.where("p_size > 25").select("brand", F.col("p_partkey").alias("save_id"), "content"), p.where("p_size <= 25").select("brand", F.col("p_partkey").alias("entry_id"), "content"), ["brand"])
    return found.select("brand", "save_id", "entry_id", F.round("similarity", 6).alias("similarity"))


@query("stranded_rows", with_sql(""" SELECT j.id, CASE WHEN f.id IS NOT NULL THEN 'promoted_l4' WHEN e.id IS NOT NULL THEN 'saved_l3' ELSE 'unaccounted' END AS verdict FROM journal j
LEFT JOIN (SELECT DISTINCT layer, user_id, id - 2 AS id FROM journal WHERE layer = 'agent') f ON f.layer = j.layer AND f.user_id = j.user_id AND f.id = j.id
LEFT JOIN (SELECT DISTINCT layer, user_id, id + 1 AS id FROM journal WHERE raw_type = 'service') e ON e.layer = j.layer AND e.user_id = j.user_id AND e.id = j.id WHERE j.ts <= 999400""", "journal"))
def stranded_rows(spark: SparkSession, d: str) -> DataFrame:
    j = ad.journal(spark, d)
    facts = j.where("layer = 'agent'").select("layer", "user_id", (F.col("id") - 2).alias("source_raw_id"))
    episodes = j.where("raw_type = 'service'").select("layer", "user_id", F.array(F.lit("kept"), F.concat(F.lit("raw:"), (F.col("id") + 1).cast("string"))).alias("tags"))
    return cv.stranded(j, facts, episodes, 1_000_000)


@query("pending_proposals", with_sql(""", p AS (SELECT a.*, (SELECT max(b.ts) FROM audit b WHERE b.action = 'error' AND b.user_id = a.user_id AND b.target_id IS NOT DISTINCT FROM a.target_id AND b.ts <= a.ts) AS last FROM audit a WHERE action = 'click')
SELECT user_id, target_id, min(ts) AS first_at, max(ts) AS at, count(*) AS n FROM p WHERE last IS NULL OR ts - last >= 604800 GROUP BY user_id, target_id""", "audit"))
def pending_proposals(spark: SparkSession, d: str) -> DataFrame:
    a = ad.audit(spark, d).withColumnRenamed("ts", "at").withColumnRenamed("value", "payload")
    return cv.pending(a.where("action = 'click'"), a.where("action = 'error'"), ["user_id", "target_id"], 7 * 86_400).drop("payload")


STATES = {"click": "staging", "view": "episode", "purchase": "l4", "signup": "archived", "error": "l2_session"}
_STATE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"


@query("legal_moves", with_sql(f""", m AS (SELECT log_id, lag({_STATE.format(c="action")}) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS a, {_STATE.format(c="action")} AS b FROM audit)
SELECT log_id, a || '->' || b AS kind FROM m WHERE (a, b) IN ({", ".join(map(str, cv.STEPS))})""", "audit"))
def legal_moves(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    a = ad.audit(spark, d).withColumn("to_state", names[F.col("action")])
    before = F.lag("to_state").over(Window.partitionBy("user_id").orderBy("ts", "log_id"))
    return cv.legal_steps(a.withColumn("from_state", before)).select("log_id", "kind")


@query("bound_events", with_sql(""", g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, log_id) <= 14400 THEN 0 ELSE 1 END AS new, log_id FROM audit WHERE action <> 'purchase'),
s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS no FROM g) GROUP BY user_id, no)
SELECT log_id, s.a AS start_ts, s.b AS end_ts FROM audit e JOIN s ON e.user_id = s.user_id AND e.ts BETWEEN s.a AND s.b WHERE action = 'purchase'""", "audit"))
def bound_events(spark: SparkSession, d: str) -> DataFrame:
    a = ad.audit(spark, d)
    spans = wn.session_spans(a.where("action <> 'purchase'"), ["user_id"], gap=14_400)
    return jn.in_interval(a.where("action = 'purchase'"), spans, ["user_id"], "ts", "start_ts", "end_ts").select("log_id", "start_ts", "end_ts")


@query("topic_segments")
def topic_segments(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return cv.segments(c, ["conv_id"], "turn")


def _sql_markdown(c: str) -> str:
    quote = lambda x: x.replace("'", "''")
    for pattern, by in fs.HTML_STEPS:
        c = f"regexp_replace({c}, '{quote(pattern)}', '{quote(by)}', 'g')"
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query("pages_as_markdown", f"WITH m AS (SELECT page_id, {_sql_markdown('html')} AS t FROM pages) SELECT page_id, length(t)::int AS n_chars, md5(t) AS digest FROM m")
def pages_as_markdown(spark: SparkSession, d: str) -> DataFrame:
    m = ad.table(spark, d, "pages").select("page_id", fs.html_to_markdown(F.col("html")).alias("t"))
    return m.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("orphan_anchors", with_sql(f", {_LONE} SELECT node_id FROM nt LEFT JOIN edges ON target_id = node_id WHERE node_type = 'promo' AND source_id IS NULL", "nodes", "edges"))
def orphan_anchors(spark: SparkSession, d: str) -> DataFrame:
    nodes = _with_lone(spark, d).withColumn("created_at", F.lit(NOW - 30 * ad.DAY))
    return mn.old_anchors(nodes, ad.edges(spark, d), NOW, "promo").select("node_id")
