"""Named queries of recall from several sources and of the stores' upkeep, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as tx
from ..operators import graph as gr
from ..operators import miners as mn
from ..operators import recall as rc
from ..operators import stores as st
from ..operators import upkeep as up
from ..operators import windows as wn
from ..sources import adapters as ad
from ..sources.adapters import DAY, NOW, with_sql
from .queries import _ASKED, _BM25, THEN, _bm25, asked, query

_FX = f"""fx AS (SELECT *, CASE WHEN entry_id % 2 = 0 THEN 'user' ELSE 'agent' END AS layer, CASE entry_id % 10 WHEN 0 THEN 'pinned' WHEN 1 THEN 'private' WHEN 2 THEN 'hidden' ELSE 'visible' END AS visibility, created_at + (entry_id % 900) * {DAY} AS expires_at, CASE WHEN entry_id % 4 = 0 THEN 'manual' ELSE 'auto' END AS source FROM facts)"""


def facts_x(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("entry_id")
    return ad.facts(spark, d).select(
        "*", F.when(e % 2 == 0, "user").otherwise("agent").alias("layer"), F.when(e % 10 == 0, "pinned").when(e % 10 == 1, "private").when(e % 10 == 2, "hidden").otherwise("visible").alias("visibility"),
        (F.col("created_at") + (e % 900) * DAY).alias("expires_at"), F.when(e % 4 == 0, "manual").otherwise("auto").alias("source"),
    )


def fx(body: str, *more: str, recursive: bool = False) -> str:
    return with_sql(f", {_FX}{body}", "facts", *more, recursive=recursive)


# -- lists and filters --------------------------------------------------------------------


@query("facts_of_kind", fx(" SELECT entry_id, round(importance, 6) AS importance FROM fx WHERE memory_kind = 'goal' AND importance >= 0.5 ORDER BY importance DESC, entry_id LIMIT 50"))
def facts_of_kind(spark, d):
    f = facts_x(spark, d).where("memory_kind = 'goal' and importance >= 0.5")
    return f.orderBy(F.desc("importance"), "entry_id").limit(50).select("entry_id", F.round("importance", 6).alias("importance"))


@query("pinned_facts", fx(" SELECT entry_id FROM fx WHERE visibility = 'pinned'"))
def pinned_facts(spark, d):
    return facts_x(spark, d).where("visibility = 'pinned'").select("entry_id")


@query("scoped_filter", fx(" SELECT entry_id, layer FROM fx WHERE importance >= 0.2 AND importance <= 0.6 AND layer = 'user' AND user_id = 'u3' ORDER BY created_at DESC, entry_id DESC LIMIT 200"))
def scoped_filter(spark, d):
    from ..operators import filters as fl

    return fl.query_memory(facts_x(spark, d), importance_min=0.2, importance_max=0.6, layer="user", user_id="u3", limit=200).select("entry_id", "layer")


@query("nodes_matching", with_sql(" SELECT node_id, node_type FROM nodes WHERE contains(lower(content), 'al') AND node_type LIKE 'promo%'", "nodes"))
def nodes_matching(spark, d):
    return ad.nodes(spark, d).where(F.contains(F.lower("content"), F.lit("al")) & F.col("node_type").like("promo%")).select("node_id", "node_type")


@query("timeline_page", with_sql(" SELECT log_id, ts FROM audit ORDER BY ts, log_id LIMIT 100 OFFSET 50", "audit"))
def timeline_page(spark, d):
    return ad.audit(spark, d).orderBy("ts", "log_id").offset(50).limit(100).select("log_id", "ts")


@query("overdue_rows", with_sql(f", j AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'received' ELSE 'saved_l3' END AS status FROM journal) SELECT id, CASE WHEN status = 'received' AND ts < 2000000 - 7 * {DAY} THEN 'gated_out' ELSE status END AS status, CASE WHEN status = 'received' AND ts < 2000000 - 7 * {DAY} THEN 1 ELSE 0 END::int AS n FROM j", "journal"))
def overdue_rows(spark, d):
    j = ad.journal(spark, d).withColumn("status", F.when(F.col("id") % 3 == 0, "received").otherwise("saved_l3")).withColumn("decisions", F.array().cast("array<string>"))
    return up.overdue(j, 2_000_000).select("id", "status", F.size("decisions").alias("n"))


# -- recall -------------------------------------------------------------------------------

_NODES = f"nx AS (SELECT node_id, layer, content, node_type, length(content) / 60 AS confidence, {NOW} - length(content) * {DAY} AS created_at FROM nodes)"
ASKS = [("a1", "small urgent in"), ("a2", "list all promo"), ("a3", "почему blue and urgent supplier xyzzy"), ("a4", "low specified"), ("a5", "Supplier#0000000")]
_ASKS = "asks AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ASKS) + ") t(query_id, query))"
SYN = {"small": ["petit", "tiny"], "blue": ["azure"]}
RENAMED = {"urgent": "pressing", "high": "urgent"}


def nodes_x(spark, d):
    return ad.nodes(spark, d).withColumn("confidence", F.length("content") / 60).withColumn("created_at", F.lit(NOW) - F.length("content") * DAY)


def asks(spark):
    return spark.createDataFrame(ASKS, "query_id string, query string")


def _hits(spark, d, intent):
    q, nodes = asks(spark), nodes_x(spark, d)
    uses = ad.audit(spark, d).where("action = 'click'").groupBy(F.col("log_id").alias("entry_id")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    core = rc.core_source(ad.facts(spark, d), q, uses, NOW, intent)
    epi = rc.episode_source(ad.episodes(spark, d), q, NOW, intent)
    return [core, epi, rc.graph_source(nodes, q, intent), rc.entity_source(nodes, q, SYN, intent)]


_ACT = "CASE WHEN {n} <= 0 THEN 0 ELSE greatest(0, least(1, 1 - exp(-(ln(1 + {n}) - 0.5::double * ln(1 + greatest({now} - {last}, 0)))))) END"


def _source_sql(intent: str) -> str:
    w = lambda s: f"{rc.weight_of(intent, s)}::double"
    lift = lambda c: f"CASE WHEN max({c}) OVER (PARTITION BY query_id) - min({c}) OVER (PARTITION BY query_id) < 1e-12 THEN 1 ELSE 1 + 0.3::double * ({c} - min({c}) OVER (PARTITION BY query_id)) / (max({c}) OVER (PARTITION BY query_id) - min({c}) OVER (PARTITION BY query_id)) END"
    return f""", {_NODES}, {_ASKS}, words AS (SELECT query_id, word FROM (SELECT query_id, unnest(string_split(lower(query), ' ')) AS word FROM asks) WHERE length(word) >= 3),
uses AS (SELECT log_id AS entry_id, count(*) AS n, max(ts) AS last_ts FROM audit WHERE action = 'click' GROUP BY log_id),
c0 AS (SELECT DISTINCT query_id, f.entry_id, value, importance, memory_kind, created_at FROM facts f JOIN words ON contains(lower(key || ' ' || value), word)),
c1 AS (SELECT c0.*, {_ACT.format(n="coalesce(n, 0)", now=NOW, last="coalesce(last_ts, created_at)")} AS act FROM c0 LEFT JOIN uses USING (entry_id)),
core AS (SELECT query_id, 'core' AS source, entry_id::varchar AS native_id, value AS content, importance * {w("core")} * CASE WHEN memory_kind IN ('instruction', 'rule', 'commitment') THEN 1.1 ELSE 1 END * {lift("act")} AS score, created_at FROM c1),
e0 AS (SELECT DISTINCT query_id, episode_id, summary, weight, created_at FROM episodes JOIN words ON contains(lower(summary), word)), e1 AS (SELECT *, {_ACT.format(n="1", now=NOW, last="created_at")} AS act FROM e0),
epi AS (SELECT query_id, 'episodic' AS source, episode_id::varchar AS native_id, summary AS content, weight * {w("episodic")} * {lift("act")} AS score, created_at FROM e1),
graph AS (SELECT query_id, 'graph' AS source, node_id AS native_id, content, confidence * {w("graph")} AS score, created_at FROM nx JOIN asks ON contains(lower(content), lower(query))),
members AS (SELECT 'a3' AS query_id, unnest(['azure', 'blue']) AS word UNION ALL SELECT 'a1', unnest(['petit', 'small', 'tiny'])),
ent AS (SELECT DISTINCT query_id, 'entities' AS source, node_id AS native_id, content, {rc.ENTITY_SCORE * rc.weight_of(intent, "entities")}::double AS score, created_at FROM nx JOIN members ON contains(lower(content), word)),
alls AS (SELECT * FROM core UNION ALL SELECT * FROM epi UNION ALL SELECT * FROM graph UNION ALL SELECT * FROM ent)"""


def _merged_sql(limit: int) -> str:
    return f""", pool AS (SELECT * FROM alls QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 6) DESC, native_id) <= {2 * limit}),
once AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, substr(content, 1, 200) ORDER BY source, round(score, 6) DESC, native_id) = 1),
mm AS (SELECT *, min(score) OVER (PARTITION BY query_id, source) AS lo, max(score) OVER (PARTITION BY query_id, source) AS hi FROM once),
sc AS (SELECT query_id, source, native_id, content, created_at, CASE WHEN hi - lo < 1e-12 THEN 1.0::double ELSE (score - lo) / (hi - lo) END * (1 + 0.5::double * pow(0.5::double, greatest({NOW} - created_at, 0) / 86400 / 30)) AS score FROM mm),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, source, native_id) AS place FROM sc QUALIFY place <= {limit})"""


@query("multi_source_search", with_sql(_source_sql("core") + _merged_sql(10) + " SELECT query_id, source, native_id, round(score, 6) AS score, place FROM merged", "facts", "episodes", "nodes", "audit"))
def multi_source_search(spark, d):
    found = rc.multi_source(_hits(spark, d, "core"), NOW, 10)
    return found.select("query_id", "source", "native_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("graph_expansion", with_sql(_source_sql("balanced") + """, b AS (SELECT source_id AS node, target_id AS nb, weight FROM edges UNION ALL SELECT target_id, source_id, weight FROM edges)
SELECT g.query_id, b.nb AS native_id, round(max(0.5::double * b.weight * n.confidence), 6) AS score FROM graph g JOIN b ON b.node = g.native_id JOIN nx n ON n.node_id = b.nb WHERE NOT EXISTS (SELECT 1 FROM graph h WHERE h.query_id = g.query_id AND h.native_id = b.nb) GROUP BY ALL""", "facts", "episodes", "nodes", "audit", "edges"))
def graph_expansion(spark, d):
    hits = _hits(spark, d, "balanced")[2]
    return rc.graph_expansion(hits, ad.edges(spark, d), nodes_x(spark, d)).select("query_id", "native_id", F.round("score", 6).alias("score"))


_CLASS = "CASE query_id WHEN 'a2' THEN 'enumerative' WHEN 'a3' THEN 'multi_hop' ELSE 'factual' END"


def _factor(content: str, asks_: str) -> str:
    return " * ".join(f"CASE WHEN contains(lower({content}), '{o}') AND NOT contains(lower({content}), '{n}') AND NOT contains(lower({asks_}), '{o}') THEN 0.7::double ELSE 1 END" for o, n in RENAMED.items())


@query("routed_search", with_sql(_source_sql("balanced") + _merged_sql(10) + f""", dense AS (SELECT query_id, source, native_id, content, score / 1.5::double AS score FROM merged WHERE source IN ('core', 'episodic')), second AS (SELECT query_id, source, native_id, content, score / 1.5::double AS score FROM merged),
cls AS (SELECT query_id, query, {_CLASS} AS route FROM asks), whole AS (SELECT 'a2' AS query_id, 's2_exhaustive' AS source, node_id AS native_id, content, confidence AS score, 0 AS pass FROM nx WHERE node_type = 'promo'),
got AS (SELECT query_id FROM whole GROUP BY query_id HAVING count(*) >= 2), rest AS (SELECT * FROM cls WHERE query_id NOT IN (SELECT query_id FROM got)), first AS (SELECT d.* FROM dense d SEMI JOIN rest USING (query_id)),
tw AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(query), '[\\pL\\pN]+'), lambda x: length(x) >= 3)) AS q FROM rest),
cov AS (SELECT f.query_id, len(list_distinct(flatten(list(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(content), '[\\pL\\pN]+'), lambda x: length(x) >= 3)), q))))) / greatest(len(any_value(q)), 1) AS c FROM first f JOIN tw USING (query_id) GROUP BY f.query_id),
uns AS (SELECT query_id FROM rest LEFT JOIN cov USING (query_id) WHERE route = 'multi_hop' AND coalesce(c, 0) < 0.3),
more AS (SELECT s.* FROM second s SEMI JOIN uns USING (query_id) ANTI JOIN first USING (query_id, source, native_id)),
both_ AS (SELECT *, 0 AS pass FROM first UNION ALL SELECT *, 1 FROM more), kept AS (SELECT query_id, source, native_id, content, score, pass FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM both_) WHERE top >= 0.12 UNION ALL SELECT * FROM whole WHERE query_id IN (SELECT query_id FROM got)),
sig AS (SELECT k.query_id, route, source, native_id, pass, k.score * {_factor("content", "query")} AS score FROM kept k JOIN cls USING (query_id))
SELECT query_id, route, source, native_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY pass, round(score, 6) DESC, source, native_id) AS place FROM sig QUALIFY place <= 10""", "facts", "episodes", "nodes", "audit"))
def routed_search(spark, d):
    """Dense hits are the merged facts and episodes, the second pass all sources; scores are brought to 0..1."""
    pool = rc.multi_source(_hits(spark, d, "balanced"), NOW, 10).withColumn("score", F.col("score") / 1.5)
    nodes = nodes_x(spark, d)
    out = rc.routed(asks(spark), nodes, pool.where("source in ('core', 'episodic')"), pool, RENAMED, 10)
    return out.select("query_id", "route", "source", "native_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("field_boost", f"WITH {_ASKED}, {_BM25}, f AS (SELECT doc_id, ['customer', 'order', 'q' || doc_id::varchar] AS w FROM documents WHERE doc_id % 3 = 0), t AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(query), '[\\pL\\pN]+'), lambda x: length(x) >= 3)) AS q FROM asked) SELECT bm.query_id, bm.doc_id, round(score + 0.1::double * coalesce(len(list_intersect(q, w)), 0), 6) AS score FROM bm JOIN t USING (query_id) LEFT JOIN f ON f.doc_id = bm.doc_id")
def field_boost(spark, d):
    docs = ad.table(spark, d, "documents").where("doc_id % 3 = 0")
    fields = docs.select(F.col("doc_id").alias("native_id"), F.array(F.lit("customer"), F.lit("order"), F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("words"))
    out = rc.field_boost(_bm25(spark, d).withColumnRenamed("doc_id", "native_id"), asked(spark), fields)
    return out.select("query_id", F.col("native_id").alias("doc_id"), F.round("score", 6).alias("score"))


_SCOPED = "s AS (SELECT *, CASE entry_id % 4 WHEN 0 THEN 'earlier' WHEN 1 THEN 'later' END AS scope FROM facts)"


@query("superseded_recall", with_sql(f", {_SCOPED} SELECT entry_id, NOT (coalesce(scope = 'earlier', false) AND EXISTS (SELECT 1 FROM s t WHERE t.user_id = s.user_id AND t.key = s.key AND t.scope = 'later')) AS is_current FROM s", "facts"))
def superseded_recall(spark, d):
    f = ad.facts(spark, d).withColumn("scope", F.when(F.col("entry_id") % 4 == 0, "earlier").when(F.col("entry_id") % 4 == 1, "later")).withColumn("contradicts", F.lit(None).cast("string"))
    return rc.current_facts(f, ["user_id"]).select("entry_id", "is_current")


@query("facts_per_kind", fx(" SELECT entry_id, memory_kind FROM fx WHERE memory_kind IN ('fact', 'goal') QUALIFY row_number() OVER (PARTITION BY memory_kind ORDER BY round(importance, 6) DESC, entry_id) <= 7"))
def facts_per_kind(spark, d):
    return rc.per_kind(facts_x(spark, d), ["fact", "goal"], 7).select("entry_id", "memory_kind")


@query("facts_then_episodes", with_sql(", p AS (SELECT 'u3' AS k, 0 AS part, entry_id AS id FROM facts WHERE user_id = 'u3' AND importance > 0.9 UNION ALL SELECT 'u3', 1, episode_id FROM episodes WHERE weight > 0.5) SELECT id, part FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY part, id) <= 40", "facts", "episodes"))
def facts_then_episodes(spark, d):
    a = ad.facts(spark, d).where("user_id = 'u3' and importance > 0.9").select(F.lit("u3").alias("k"), F.col("entry_id").alias("id"))
    b = ad.episodes(spark, d).where("weight > 0.5").select(F.lit("u3").alias("k"), F.col("episode_id").alias("id"))
    return rc.in_order([a, b], ["k"], 40, ["id"]).select("id", "part")


_LINKS = "lk AS (SELECT 's' || (s_suppkey % 97)::varchar AS a, 'n' || s_nationkey::varchar AS b FROM supplier UNION SELECT 'n' || n_nationkey::varchar, 'r' || n_regionkey::varchar FROM nation UNION SELECT 'r' || r_regionkey::varchar, 's' || (r_regionkey * 3)::varchar FROM region)"


def links_x(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.expr(c).cast("string"))
    s = ad.table(spark, d, "supplier").select(name("s", "s_suppkey % 97").alias("from_path"), name("n", "s_nationkey").alias("to_path"))
    n = ad.table(spark, d, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))
    r = ad.table(spark, d, "region").select(name("r", "r_regionkey"), name("s", "r_regionkey * 3"))
    return s.union(n).union(r).distinct()


@query("link_reach", f"""WITH RECURSIVE {_LINKS}, w(o, p, k) AS (SELECT o, o, 0 FROM (VALUES ('s3'), ('n5')) t(o) UNION SELECT w.o, x.b, k + 1 FROM w JOIN (SELECT a, b FROM lk UNION SELECT b, a FROM lk) x ON x.a = w.p WHERE k < 3)
SELECT o AS origin, p AS path, min(k)::int AS depth FROM w GROUP BY ALL HAVING min(k) > 0""")
def link_reach(spark, d):
    return rc.link_reach(links_x(spark, d), spark.createDataFrame([("s3",), ("n5",)], "path string"), 3, "both")


@query("link_walks", f"WITH {_LINKS} SELECT 's3' AS origin, x.b AS path, 1 AS depth FROM lk x WHERE x.a = 's3' UNION ALL SELECT 's3', y.b, 2 FROM lk x JOIN lk y ON y.a = x.b WHERE x.a = 's3' UNION ALL SELECT 's3', z.b, 3 FROM lk x JOIN lk y ON y.a = x.b JOIN lk z ON z.a = y.b WHERE x.a = 's3'")
def link_walks(spark, d):
    return rc.relations_to_depth(links_x(spark, d), spark.createDataFrame([("s3",)], "path string"), 3)


@query("led_to_neighbours", with_sql(f", l AS (SELECT source_id AS a, target_id AS b FROM edges WHERE valid_from <= {THEN} AND (valid_to IS NULL OR valid_to >= {THEN}) UNION ALL SELECT target_id, source_id FROM edges WHERE valid_from <= {THEN} AND (valid_to IS NULL OR valid_to >= {THEN})) SELECT a AS node, count(DISTINCT b)::int AS n, min(b) AS first FROM l JOIN nodes ON node_id = a WHERE node_type = 'supplier' GROUP BY a", "edges", "nodes"))
def led_to_neighbours(spark, d):
    e = ad.edges(spark, d).withColumn("relation", F.lit("led_to"))
    start = ad.nodes(spark, d).where("node_type = 'supplier'").select(F.col("node_id").alias("node"))
    return rc.led_to_neighbours(e, start, THEN).select("node", F.size("neighbours").alias("n"), F.array_min("neighbours").alias("first"))


# -- facts and versions -------------------------------------------------------------------

_SAVES = f"""cur AS (SELECT user_id, key, value, importance, memory_kind, created_at + 5 * {DAY} AS expires_at, CASE WHEN entry_id % 3 = 0 THEN 'pinned' ELSE 'visible' END AS visibility, created_at AS "at" FROM facts WHERE created_at <= {THEN} QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, entry_id DESC) = 1),
sv AS (SELECT user_id, key, value, entry_id, CASE WHEN entry_id % 2 = 0 THEN importance * 2 END AS importance, CASE WHEN entry_id % 5 > 0 THEN memory_kind END AS memory_kind, created_at AS "at" FROM facts WHERE created_at > {THEN}),
s2 AS (SELECT sv.user_id, sv.key, sv.value, least(1, greatest(0, coalesce(sv.importance, k.default_importance, 0.5))) AS importance, k.memory_kind, CASE WHEN k.needs_expiry THEN "at" + 30 * {DAY} END AS expires_at, NULL AS visibility, "at" FROM sv JOIN kinds k ON coalesce(sv.memory_kind, 'fact') = k.memory_kind),
b AS (SELECT *, 0 AS new FROM cur UNION ALL SELECT *, 1 FROM s2), ch AS (SELECT *, coalesce(last_value(visibility IGNORE NULLS) OVER w, 'visible') AS vis, lag(value) OVER w AS old_value, lead("at") OVER w AS valid_to FROM b WINDOW w AS (PARTITION BY user_id, key ORDER BY "at", new, value, importance NULLS FIRST, memory_kind NULLS FIRST, expires_at NULLS FIRST, visibility NULLS FIRST))"""


def _saved(spark, d):
    f = ad.facts(spark, d)
    cur = wn.latest(f.where(F.col("created_at") <= THEN), ["user_id", "key"], F.desc("created_at"), F.desc("entry_id"))
    cur = cur.select("user_id", "key", "value", "importance", "memory_kind", (F.col("created_at") + 5 * DAY).alias("expires_at"), F.when(F.col("entry_id") % 3 == 0, "pinned").otherwise("visible").alias("visibility"), F.col("created_at").alias("at"))
    e = F.col("entry_id")
    sv = f.where(F.col("created_at") > THEN).select("user_id", "key", "value", F.when(e % 2 == 0, F.col("importance") * 2).alias("importance"), F.when(e % 5 > 0, F.col("memory_kind")).alias("memory_kind"), F.lit(None).cast("long").alias("expires_at"), F.lit(None).cast("string").alias("visibility"), F.col("created_at").alias("at"))
    return up.save_facts(cur, sv, policy.kinds(spark), ["user_id", "key"])


@query("fact_upsert", with_sql(f", {_SAVES} SELECT user_id, key, value, round(importance, 6) AS importance, memory_kind, expires_at, vis AS visibility, ch.at FROM ch WHERE valid_to IS NULL", "facts", "kinds"))
def fact_upsert(spark, d):
    return _saved(spark, d)["facts"].withColumn("importance", F.round("importance", 6))


@query("fact_upsert_history", with_sql(f", {_SAVES} SELECT user_id, key, old_value, value AS new_value, ch.at, CASE WHEN old_value IS NULL THEN 'created' ELSE 'updated' END AS change FROM ch WHERE new = 1", "facts", "kinds"))
def fact_upsert_history(spark, d):
    return _saved(spark, d)["history"]


@query("fact_upsert_intervals", with_sql(f", {_SAVES} SELECT user_id, key, value, ch.at AS valid_from, valid_to FROM ch", "facts", "kinds"))
def fact_upsert_intervals(spark, d):
    return _saved(spark, d)["intervals"]


_LAST = "l AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, entry_id DESC) = 1)"


def _latest(spark, d):
    return wn.latest(ad.facts(spark, d), ["user_id", "key"], F.desc("created_at"), F.desc("entry_id"))


@query("deleted_facts", with_sql(f", {_LAST} SELECT user_id, key, value AS old_value, created_at AS valid_from, {NOW}::bigint AS valid_to FROM l WHERE entry_id % 4 = 1", "facts"))
def deleted_facts(spark, d):
    f = _latest(spark, d).withColumn("at", F.col("created_at"))
    gone = up.delete_facts(f, f.where("entry_id % 4 = 1"), ["user_id", "key"], NOW)
    return gone["history"].select("user_id", "key", "old_value").join(gone["intervals"], ["user_id", "key"]).withColumn("valid_to", F.col("valid_to").cast("long"))


@query("rolled_back_facts", with_sql(f", {_LAST}, g AS (SELECT user_id, key, CASE WHEN entry_id % 2 = 0 THEN 'old ' || key END AS old_value FROM l WHERE entry_id % 3 = 0) SELECT l.user_id, l.key, CASE WHEN g.key IS NULL THEN value ELSE old_value END AS value FROM l LEFT JOIN g USING (user_id, key) WHERE g.key IS NULL OR old_value IS NOT NULL", "facts"))
def rolled_back_facts(spark, d):
    f = _latest(spark, d)
    ledger = f.where("entry_id % 3 = 0").select("user_id", "key", F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("old "), "key")).alias("old_value"))
    return up.rolled_back(f.select("user_id", "key", "value"), ledger, ["user_id", "key"])


@query("condition_splits", with_sql(", n AS (SELECT *, count(*) OVER (PARTITION BY user_id, key) AS n, row_number() OVER (PARTITION BY user_id, key ORDER BY created_at, entry_id) AS k FROM facts) SELECT entry_id, CASE WHEN n > 1 THEN CASE WHEN k = n THEN 'later' ELSE 'earlier' END END AS scope, round(CASE WHEN n > 1 THEN 0.9::double * importance ELSE importance END, 6) AS importance, CASE WHEN n > 1 AND k = n THEN key || '::v' || n::varchar ELSE key END AS versioned_key FROM n", "facts"))
def condition_splits(spark, d):
    s = up.split_by_condition(ad.facts(spark, d), ["user_id", "key"], ["created_at", "entry_id"])
    return s.select("entry_id", "scope", F.round("importance", 6).alias("importance"), "versioned_key")


@query("resolved_conflicts", with_sql(", g AS (SELECT user_id || key AS g, entry_id FROM facts), k AS (SELECT g, max(entry_id) AS e FROM g GROUP BY g HAVING count(*) > 1) SELECT entry_id FROM g JOIN k USING (g) WHERE entry_id <> e", "facts"))
def resolved_conflicts(spark, d):
    g = ad.facts(spark, d).select(F.concat("user_id", "key").alias("group_id"), "entry_id")
    keep = g.groupBy("group_id").agg(F.max("entry_id").alias("entry_id"), F.count("*").alias("n")).where("n > 1").select("group_id", "entry_id")
    return up.resolved(g, keep).select("entry_id")


@query("archive_bin", fx(f" SELECT entry_id, CASE WHEN expires_at < {THEN} THEN 'expired' ELSE 'inactive_90d' END AS archive_reason FROM fx WHERE importance < 0.3"))
def archive_bin(spark, d):
    return up.bin_rows(facts_x(spark, d).where("importance < 0.3"), THEN).select("entry_id", "archive_reason")


_BIN = """bin AS (SELECT user_id, key, entry_id // 2 AS original_id, CASE entry_id % 5 WHEN 0 THEN 'episodes' WHEN 1 THEN 'other' ELSE 'core_memory' END AS memory_type, CASE WHEN entry_id % 7 = 0 THEN 'purge:owner' ELSE 'expired' END AS archive_reason FROM facts WHERE importance < 0.5),
held AS (SELECT DISTINCT user_id, key FROM facts WHERE importance >= 0.5 AND entry_id % 2 = 0 OR entry_id % 9 = 0)"""
_REFUSAL = "CASE WHEN count(*) OVER (PARTITION BY original_id) > 1 THEN 'ambiguous' WHEN archive_reason LIKE 'purge%' THEN 'purged' WHEN memory_type NOT IN ('core_memory', 'episodes') THEN 'unroutable' WHEN memory_type = 'core_memory' AND (user_id, key) IN (SELECT (user_id, key) FROM held) THEN 'already_present' END"


def _restorable(spark, d):
    f, e = ad.facts(spark, d), F.col("entry_id")
    b = f.where("importance < 0.5").select("user_id", "key", F.floor(e / 2).alias("original_id"), F.when(e % 5 == 0, "episodes").when(e % 5 == 1, "other").otherwise("core_memory").alias("memory_type"), F.when(e % 7 == 0, "purge:owner").otherwise("expired").alias("archive_reason"))
    return up.restorable(b, f.where("importance >= 0.5 and entry_id % 2 = 0 or entry_id % 9 = 0"), ["user_id", "key"])


@query("restore_refusals", with_sql(f", {_BIN} SELECT original_id, key, {_REFUSAL} AS refusal FROM bin", "facts"))
def restore_refusals(spark, d):
    return _restorable(spark, d).select("original_id", "key", "refusal")


@query("bin_listing", with_sql(f", {_BIN}, r AS (SELECT {_REFUSAL} AS refusal FROM bin) SELECT coalesce(refusal, 'restorable') AS state, count(*) AS n FROM r GROUP BY 1", "facts"))
def bin_listing(spark, d):
    return _restorable(spark, d).groupBy(F.coalesce("refusal", F.lit("restorable")).alias("state")).agg(F.count("*").alias("n"))


@query("forget_plan", with_sql(f" SELECT entry_id, 'exact' AS scope FROM facts WHERE key = 'Customer#000000001' UNION ALL SELECT entry_id, 'fuzzy' FROM facts WHERE contains(lower(key || chr(10) || value), 'urgent') UNION ALL SELECT entry_id, 'recent' FROM facts WHERE created_at > {THEN} UNION ALL SELECT entry_id, 'ids' FROM facts WHERE entry_id IN (1, 2, 3)", "facts"))
def forget_plan(spark, d):
    f = ad.facts(spark, d)
    parts = [up.forgotten(f, "exact", key="Customer#000000001"), up.forgotten(f, "fuzzy", key="Urgent"), up.forgotten(f, "recent", since=THEN), up.forgotten(f, "ids", ids=[1, 2, 3])]
    a, b, c, e = (p.select("entry_id", F.lit(s).alias("scope")) for p, s in zip(parts, ("exact", "fuzzy", "recent", "ids")))
    return a.unionByName(b).unionByName(c).unionByName(e)


WEIGHTS = {"base": 0.3, "length": 0.1, "question": 0.1, "tech": 0.2, "emotion": 0.1, "novelty": 0.1, "retrieval": 0.1}
_SCORE = "(0.3::double * default_importance + 0.1::double * least(1, length(value) / 800) + 0.2::double * least(1, 0.25::double * (contains(lower(value), 'high')::int + contains(lower(value), 'urgent')::int)) + 0.1::double * 0.2 + 0.1::double * 0.7 + 0.1::double * CASE WHEN n > 0 THEN least(1, ln(1 + n) / 5) ELSE 0.2 END) / 1.0"


@query("rescored_facts", fx(f", u AS (SELECT log_id AS entry_id, count(*) AS n FROM audit WHERE action = 'click' GROUP BY 1), s AS (SELECT fx.entry_id, importance, {_SCORE} * (1 - 0.05::double) AS sc FROM (SELECT fx.*, coalesce(n, 0) AS n FROM fx LEFT JOIN u USING (entry_id)) fx JOIN kinds USING (memory_kind) WHERE created_at > {THEN} - 30 * {DAY} AND source <> 'manual') SELECT entry_id, round(importance, 6) AS old_importance, round(sc, 6) AS new_importance FROM s WHERE abs(sc - importance) >= 0.15", "audit", "kinds"))
def rescored_facts(spark, d):
    f = facts_x(spark, d).join(policy.kinds(spark).select("memory_kind", "default_importance"), "memory_kind").withColumn("updated_at", F.col("created_at"))
    uses = ad.audit(spark, d).where("action = 'click'").groupBy(F.col("log_id").alias("entry_id")).agg(F.count("*").alias("n"))
    score = up.signal_score(F.col("default_importance"), F.col("value"), ["high", "urgent"], F.lit(0.2), F.col("n"), F.lit(0.05), WEIGHTS)
    return up.rescored(f, uses, score, ["manual"], THEN).select("entry_id", F.round("old_importance", 6).alias("old_importance"), F.round("new_importance", 6).alias("new_importance"))


@query("equal_values", with_sql(" SELECT entry_id FROM facts WHERE (user_id, key, value) IN (SELECT (user_id, key, value) FROM facts GROUP BY user_id, key, value HAVING count(*) > 1)", "facts"))
def equal_values(spark, d):
    return up.equal_values(ad.facts(spark, d), ["user_id", "key"]).select("entry_id")


# -- episodes and journal -----------------------------------------------------------------


@query("promotion_batch", with_sql(" SELECT episode_id, substr(summary, 1, 200) AS value FROM episodes WHERE weight > 0.4 AND episode_id % 3 > 0 ORDER BY created_at, episode_id LIMIT 10", "episodes"))
def promotion_batch(spark, d):
    e = up.add_tag(ad.episodes(spark, d), F.when(F.col("episode_id") % 3 == 0, "l4:seen").otherwise("new"))
    return up.to_promote(e, 10, 0.4).select("episode_id", "value")


@query("compressible_episodes", with_sql(f" SELECT episode_id FROM episodes WHERE weight < 0.31 AND created_at < {NOW} - 5 * {DAY}", "episodes"))
def compressible_episodes(spark, d):
    return up.to_compress(ad.episodes(spark, d), NOW, 5, 0.31).select("episode_id")


_TW = "tw AS (SELECT 'u' || (id % 3)::varchar AS user_id, id AS episode_id, substr(text, 1, 2) || raw_type AS summary, CASE WHEN id % 5 = 0 THEN [] ELSE ['raw:' || (id % 2)::varchar] END AS tags, (id % 4 = 0)::int * 0.5::double AS weight, ts AS created_at FROM journal)"


@query("twin_classes", with_sql(f", {_TW}, g AS (SELECT user_id, summary, count(*) AS n, list_distinct(flatten(list(tags))) AS raws, min(len(tags)) AS least, count(DISTINCT (tags, weight)) AS kinds, arg_min(episode_id, (created_at, episode_id)) AS first FROM tw GROUP BY ALL HAVING count(*) > 1) SELECT user_id, first, n, CASE WHEN len(raws) = 0 THEN 'no_raw' WHEN len(raws) > 1 THEN 'diff_raw' WHEN least = 0 THEN 'skip_partial' WHEN kinds > 1 THEN 'skip_variant' ELSE 'same_raw' END AS class FROM g", "journal"))
def twin_classes(spark, d):
    i = F.col("id")
    e = ad.journal(spark, d).select(F.concat(F.lit("u"), (i % 3).cast("string")).alias("user_id"), i.alias("episode_id"), F.concat(F.substring("text", 1, 2), "raw_type").alias("summary"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("raw:"), (i % 2).cast("string")))).alias("tags"), F.when(i % 4 == 0, 0.5).otherwise(0.0).alias("weight"), F.col("ts").alias("created_at"))
    return up.twin_classes(e)


@query("purge_plan", with_sql(" SELECT 'episode' AS kind, id + 7 AS id FROM journal WHERE raw_type = 'service' UNION ALL SELECT 'fact', id * 2 FROM journal WHERE raw_type = 'service' AND layer = 'user'", "journal"))
def purge_plan(spark, d):
    j = ad.journal(spark, d)
    e = j.select((F.col("id") + 7).alias("episode_id"), F.array(F.lit("x"), F.concat(F.lit("raw:"), F.col("id").cast("string"))).alias("tags"))
    f = j.where("layer = 'user'").select((F.col("id") * 2).alias("entry_id"), F.col("id").alias("source_raw_id"))
    return up.purge_plan(j.where("raw_type = 'service'").select("id"), e, f)


@query("redated_rows", with_sql(" SELECT id + 1 AS id, ts + id % 3 * 10 AS created_at, ts AS new_created_at FROM journal WHERE id % 3 > 0", "journal"))
def redated_rows(spark, d):
    j = ad.journal(spark, d)
    derived = j.select((F.col("id") + 1).alias("id"), F.col("id").alias("raw_id"), (F.col("ts") + F.col("id") % 3 * 10).alias("created_at"))
    return up.redated(derived, j.select(F.col("id").alias("raw_id"), "ts"))


@query("drilled_facts", with_sql(", f AS (SELECT id * 10 AS entry_id, id + id % 2 AS raw FROM journal) SELECT entry_id, length(coalesce(h.text, c.text))::int AS n_chars, CASE WHEN h.id IS NOT NULL THEN 'journal' WHEN c.id IS NOT NULL THEN 'cold' END AS found_in FROM f LEFT JOIN (SELECT * FROM journal WHERE id % 3 = 0) h ON h.id = raw LEFT JOIN (SELECT * FROM journal WHERE id % 3 = 1) c ON c.id = raw", "journal"))
def drilled_facts(spark, d):
    j = ad.journal(spark, d)
    f = j.select((F.col("id") * 10).alias("entry_id"), (F.col("id") + F.col("id") % 2).alias("source_raw_id"))
    out = up.drilled_down(f, j.where("id % 3 = 0"), j.where("id % 3 = 1"))
    return out.select("entry_id", F.length("text").alias("n_chars"), "found_in")


@query("replay_rows", with_sql(" SELECT id FROM journal WHERE id % 3 <> 0 OR id % 2 = 0", "journal"))
def replay_rows(spark, d):
    j = ad.journal(spark, d)
    judged = j.where("id % 3 = 0").select("id", F.lit("g1").alias("gate"), F.when(F.col("id") % 2 == 1, "c2").otherwise("c1").alias("config_hash"))
    return up.to_replay(j, judged, "g1", "c2").select("id")


@query("cost_cap", with_sql(f" SELECT log_id, round(sum(value) OVER w, 4) AS spent, round(sum(value) OVER w, 4) <= 120 AS within FROM audit WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW)", "audit"))
def cost_cap(spark, d):
    a = up.within_cost(ad.audit(spark, d), ["user_id"], "value", 120, 3 * DAY)
    return a.select("log_id", F.round("spent", 4).alias("spent"), (F.round("spent", 4) <= 120).alias("within"))


@query("staged_rows", with_sql(" SELECT id FROM journal WHERE ts >= 300000 - 86400 * 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) <= 9", "journal"))
def staged_rows(spark, d):
    return up.staged(ad.journal(spark, d), ["user_id"], 300_000, 72, 9).select("id")


@query("cold_months", with_sql(" SELECT id, strftime(to_timestamp(ts * 400)::timestamp, '%Y-%m') AS month, substr(text, 1, 200) AS brief, strftime(to_timestamp(ts * 400)::timestamp, '%Y-%m-%d ') AS day FROM journal WHERE id % 2 = 0", "journal"))
def cold_months(spark, d):
    t = F.timestamp_seconds(F.col("ts") * 400)
    return ad.journal(spark, d).where("id % 2 = 0").select("id", F.date_format(t, "yyyy-MM").alias("month"), F.substring("text", 1, 200).alias("brief"), F.date_format(t, "yyyy-MM-dd ").alias("day"))


@query("journal_or_cold", with_sql(" SELECT id, text IS NOT NULL AS held, id % 4 = 0 AS cold FROM journal WHERE id % 4 IN (0, 2)", "journal"))
def journal_or_cold(spark, d):
    j = ad.journal(spark, d).select("id", F.col("text").isNotNull().alias("held"))
    return j.where("id % 4 = 2").withColumn("cold", F.lit(False)).unionByName(j.where("id % 4 = 0").withColumn("cold", F.lit(True)))


@query("gap_registry", with_sql(", s AS (SELECT action || '-' || coalesce(target_id, '') AS gap, count(*) AS n FROM audit WHERE ts % 2 = 0 GROUP BY 1), k AS (SELECT action || '-' || coalesce(target_id, '') AS gap, count(*) AS n, max(ts) AS last FROM audit WHERE ts % 3 = 0 GROUP BY 1) SELECT coalesce(s.gap, k.gap) AS gap, coalesce(k.n, 0) + coalesce(s.n, 0) AS seen_count, CASE WHEN s.n IS NOT NULL THEN 5 ELSE last END::bigint AS last_seen FROM k FULL JOIN s ON s.gap = k.gap", "audit"))
def gap_registry(spark, d):
    a = ad.audit(spark, d).withColumn("gap", F.concat_ws("-", "action", F.coalesce("target_id", F.lit(""))))
    known = a.where("ts % 3 = 0").groupBy("gap").agg(F.count("*").alias("seen_count"), F.max("ts").alias("last_seen"))
    return up.gap_registry(known, a.where("ts % 2 = 0").groupBy("gap").agg(F.count("*").alias("n")), 5).withColumn("last_seen", F.col("last_seen").cast("long"))


@query("project_upsert", "WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'new ' || n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'x' END AS role FROM nation WHERE n_nationkey > 3), c AS (SELECT n_nationkey AS k, n_name AS name, 'old' AS role FROM nation WHERE n_nationkey < 20) SELECT coalesce(c.k, n.k)::bigint AS k, coalesce(nullif(n.name, ''), c.name) AS name, coalesce(n.role, c.role) AS role FROM c FULL JOIN n ON c.k = n.k")
def project_upsert(spark, d):
    t = ad.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    new = t.where("k > 3").select("k", F.when(F.col("k") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "name")).alias("name"), F.when(F.col("k") % 3 == 0, "x").alias("role"))
    return up.merged_rows(t.where("k < 20").withColumn("role", F.lit("old")), new, ["k"], ["name"])


@query("reindexed_pages", "SELECT coalesce(i.page_id, f.page_id) AS page_id, CASE WHEN i.page_id IS NULL THEN 'insert' WHEN f.page_id IS NULL THEN 'orphan' WHEN f.page_id % 5 = 0 AND length(f.html) > 0 THEN 'update' ELSE 'skip' END AS action FROM (SELECT * FROM pages WHERE page_id % 7 > 0) i FULL JOIN (SELECT * FROM pages WHERE page_id % 11 > 0) f ON i.page_id = f.page_id WHERE coalesce(i.page_id, f.page_id) IS NOT NULL")
def reindexed_pages(spark, d):
    p = ad.table(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    files = p.where("path % 11 > 0").withColumn("content", F.when(F.col("path") % 5 == 0, F.reverse(F.concat("content", F.lit("!")))).otherwise(F.col("content")))
    return up.saved_pages(p.where("path % 7 > 0"), files).select(F.col("path").alias("page_id"), "action")


@query("hub_pages", "SELECT p_brand AS type, count(*) AS n, string_agg('- [[' || p_name || ']]', chr(10) ORDER BY p_partkey DESC, p_name) AS content FROM part WHERE p_size < 5 GROUP BY p_brand HAVING count(*) >= 3")
def hub_pages(spark, d):
    return up.hub_pages(ad.table(spark, d, "part").where("p_size < 5").select(F.col("p_brand").alias("type"), F.col("p_name").alias("title"), F.col("p_partkey").alias("updated_at")))


@query("promoted_pages", with_sql(" SELECT entry_id, key FROM facts WHERE memory_kind IN ('preference', 'rule') AND importance >= 0.8 AND key NOT IN (SELECT c_name FROM customer WHERE c_custkey % 3 = 0) QUALIFY row_number() OVER (PARTITION BY key ORDER BY importance DESC, entry_id) = 1", "facts"))
def promoted_pages(spark, d):
    titles = ad.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("title"))
    return up.promoted_pages(ad.facts(spark, d), titles, ["preference", "rule"]).select("entry_id", "key")


@query("reinforced_pages", with_sql(", p AS (SELECT page_id, 0.97 AS c, 1700000000 + page_id * 1000 AS u FROM pages), r AS (SELECT log_id % 50 AS page_id, max(ts) AS t FROM audit WHERE ts >= 1704067200 GROUP BY 1) SELECT p.page_id, round(CASE WHEN t > u THEN least(1, c + 0.05) ELSE c END::double, 6) AS confidence FROM p LEFT JOIN r ON r.page_id = p.page_id", "audit"))
def reinforced_pages(spark, d):
    p = ad.table(spark, d, "pages").select("page_id", F.lit(0.97).alias("confidence"), (F.lit(1_700_000_000) + F.col("page_id") * 1000).alias("updated_at"))
    reads = ad.audit(spark, d).select((F.col("log_id") % 50).alias("page_id"), "ts")
    return up.reinforced_pages(p, reads, 1_704_067_200 + 24 * 3600).select("page_id", F.round("confidence", 6).alias("confidence"))


# -- graph and diagnostics ----------------------------------------------------------------


@query("edges_with_contents", with_sql(" SELECT source_id, target_id, s.content AS source_content, t.content AS target_content FROM edges JOIN nodes s ON s.node_id = source_id JOIN nodes t ON t.node_id = target_id", "edges", "nodes"))
def edges_with_contents(spark, d):
    return up.edges_with_ends(ad.edges(spark, d), ad.nodes(spark, d)).select("source_id", "target_id", "source_content", "target_content")


_LAYERED = "nl AS (SELECT node_id, CASE WHEN length(content) % 2 = 0 THEN 'user' ELSE 'agent' END AS layer FROM nodes WHERE node_type <> 'economy')"


@query("edge_report", with_sql(f", {_LAYERED} SELECT count(*) AS total, count_if(s.node_id IS NOT NULL AND t.node_id IS NOT NULL)::bigint AS live, count_if(s.node_id IS NULL OR t.node_id IS NULL)::bigint AS dead, count_if(s.layer <> t.layer)::bigint AS across FROM edges LEFT JOIN nl s ON s.node_id = source_id LEFT JOIN nl t ON t.node_id = target_id", "edges", "nodes"))
def edge_report(spark, d):
    n = ad.nodes(spark, d).where("node_type <> 'economy'").withColumn("layer", F.when(F.length("content") % 2 == 0, "user").otherwise("agent"))
    return up.edge_report(ad.edges(spark, d), n)


@query("near_sessions", with_sql(" SELECT DISTINCT a.log_id::varchar AS node_id, b.user_id AS session_id FROM audit a JOIN audit b ON abs(a.ts - b.ts) <= 300 WHERE a.action = 'purchase' AND b.action = 'signup'", "audit"))
def near_sessions(spark, d):
    a = ad.audit(spark, d)
    n = a.where("action = 'purchase'").select(F.col("log_id").cast("string").alias("node_id"), F.col("ts").alias("created_at"))
    return up.near_sessions(n, a.where("action = 'signup'").select(F.col("user_id").alias("session_id"), "ts"))


@query("events_near", with_sql(" SELECT p.log_id AS probe_id, e.log_id FROM audit p JOIN audit e ON p.user_id = e.user_id AND abs(e.ts - p.ts) < 7200 WHERE p.action = 'purchase' AND e.action <> 'purchase'", "audit"))
def events_near(spark, d):
    a = ad.audit(spark, d)
    probes = a.where("action = 'purchase'").select("user_id", F.col("log_id").alias("probe_id"), F.col("ts").alias("at"))
    return up.neighbours_of_time(a.where("action <> 'purchase'").select("user_id", "log_id", "ts"), probes, ["user_id"], 7200).select("probe_id", "log_id")


@query("provenance_edges", with_sql(" SELECT 'f' || entry_id::varchar AS source_id, 'episode:' || (entry_id % 50)::varchar AS target_id FROM facts WHERE entry_id % 2 = 0", "facts"))
def provenance_edges(spark, d):
    f = ad.facts(spark, d).select(F.concat(F.lit("f"), F.col("entry_id").cast("string")).alias("node_id"), F.array(F.lit("fact:1"), F.concat(F.when(F.col("entry_id") % 2 == 0, "episode:").otherwise("page:"), (F.col("entry_id") % 50).cast("string"))).alias("parents"))
    return up.provenance_edges(f).select("source_id", "target_id")


@query("question_nodes", with_sql(" SELECT user_id, min(action || ' ' || coalesce(target_id, '')) AS content, count(*) AS n FROM audit GROUP BY user_id, action, target_id HAVING count(*) >= 2 ORDER BY n DESC, user_id, content LIMIT 20", "audit"))
def question_nodes(spark, d):
    failed = ad.audit(spark, d).select("user_id", F.concat_ws(" ", "action", F.coalesce("target_id", F.lit(""))).alias("query"))
    return up.question_nodes(failed, ["user_id"])


@query("found_or_added", with_sql(", w AS (SELECT DISTINCT 'user' AS user_id, lower(p_brand) AS content, 'maker' AS node_type FROM part) SELECT w.content, sha256('user|maker|' || w.content)[1:16] AS node_id FROM w WHERE content NOT LIKE '%1'", "nodes"))
def found_or_added(spark, d):
    w = ad.table(spark, d, "part").select(F.lit("user").alias("user_id"), F.lower("p_brand").alias("content"), F.lit("maker").alias("node_type"))
    return up.find_or_add(w.where("content like '%1'"), w).select("content", "node_id")


@query("temporal_chain", with_sql(", l AS (SELECT log_id AS a, lead(log_id) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS b FROM audit) SELECT a AS origin, b AS event_id, action FROM l JOIN audit ON log_id = b WHERE a % 10 = 0", "audit"))
def temporal_chain(spark, d):
    from pyspark.sql import Window

    a = ad.audit(spark, d)
    links = a.select(F.col("log_id").alias("from_event"), F.lead("log_id").over(Window.partitionBy("user_id").orderBy("ts", "log_id")).alias("to_event"))
    events = a.withColumnRenamed("log_id", "event_id")
    return up.temporal_chain(events, links, a.where("log_id % 10 = 0").select(F.col("log_id").alias("event_id"))).select("origin", "event_id", "action")


@query("fact_links", "WITH p AS (SELECT page_id, 'x [[fact:' || (page_id % 30)::varchar || ']] y [[fact:z' || page_id::varchar || ']]' AS t FROM pages) SELECT page_id, unnest(regexp_extract_all(t, '\\[\\[fact:([^\\]]+)\\]\\]', 1)) AS key, false AS found FROM p WHERE false UNION ALL SELECT page_id, (page_id % 30)::varchar, page_id % 30 < 25 FROM p UNION ALL SELECT page_id, 'z' || page_id::varchar, false FROM p")
def fact_links(spark, d):
    k = F.col("page_id").cast("string")
    p = ad.table(spark, d, "pages").select("page_id", F.concat(F.lit("x [[fact:"), (F.col("page_id") % 30).cast("string"), F.lit("]] y [[fact:z"), k, F.lit("]]")).alias("html"))
    return up.fact_links(p, ad.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key")))


@query("fact_evidence", with_sql(""", f AS (SELECT id AS entry_id, user_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x) >= 3)) AS w0, list_sort(w0)[1:4] AS w FROM journal WHERE id % 7 = 0), j AS (SELECT id, user_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x) >= 3)) AS w FROM journal WHERE id % 7 > 0),
m AS (SELECT entry_id, len(list_intersect(f.w, j.w)) AS n, len(f.w) AS size FROM f JOIN j USING (user_id)), b AS (SELECT entry_id, max(CASE WHEN n > 0 AND n >= size THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END) AS v FROM m GROUP BY entry_id)
SELECT entry_id, CASE v WHEN 2 THEN 'exists' WHEN 1 THEN 'probable' ELSE 'unknown' END AS verdict FROM f LEFT JOIN b USING (entry_id)""", "journal"))
def fact_evidence(spark, d):
    j = ad.journal(spark, d).select("user_id", "id", tx.tokens(F.col("text")).alias("words"))
    f = j.where("id % 7 = 0").select("user_id", F.col("id").alias("entry_id"), F.slice(F.array_sort("words"), 1, 4).alias("words"))
    return up.evidence(f, j.where("id % 7 > 0"), ["user_id"])


@query("report_card", with_sql(" SELECT count(*) AS n, count_if(action = 'click')::bigint AS verified, count_if(action = 'error')::bigint AS dropped, round(100 * count_if(action = 'click') / nullif(count_if(action IN ('click', 'error')), 0), 1) AS integrity FROM audit", "audit"))
def report_card(spark, d):
    return up.report_card(ad.audit(spark, d))


@query("related_facts", with_sql(", lk AS (SELECT 'page' || s_suppkey::varchar AS page, 's' || s_suppkey::varchar AS node FROM supplier), f AS (SELECT p_partkey AS entry_id, p_name AS value FROM part WHERE p_partkey % 3 = 0), b AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges) SELECT DISTINCT page, f.entry_id FROM lk JOIN b ON b.a = lk.node JOIN nodes n ON n.node_id = b.b JOIN f ON f.value = n.content", "edges", "nodes"))
def related_facts(spark, d):
    s = F.col("s_suppkey").cast("string")
    lk = ad.table(spark, d, "supplier").select(F.concat(F.lit("page"), s).alias("page"), F.concat(F.lit("s"), s).alias("node_id"))
    f = ad.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("value"))
    # Edges by their lines: equal ones needn't be found first.
    line = ad.table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"))
    return up.related_facts(lk, ad.nodes(spark, d), line, f)


@query("page_scores", "WITH s AS (SELECT conv_id AS page_id, conv_id * 1000 + turn AS chunk_id, length(text) / 100 AS score FROM conversations) SELECT page_id, round(max(score), 6) AS score FROM s GROUP BY page_id")
def page_scores(spark, d):
    c = ad.table(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), (F.length("text") / 100).alias("score"))
    return up.chunk_hits(c.select("page_id", "chunk_id"), c.select("page_id").distinct(), c.select("chunk_id", "score")).withColumn("score", F.round("score", 6))


@query("segment_cohesion", """WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x) >= 3)) AS w FROM conversations), p AS (SELECT a.conv_id, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END AS j FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT c.conv_id, round(coalesce(avg(j), 0), 6) AS cohesion FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN p ON p.conv_id = c.conv_id GROUP BY c.conv_id""")
def segment_cohesion(spark, d):
    c = ad.table(spark, d, "conversations").select("conv_id", tx.tokens(F.col("text")).alias("words"))
    return up.cohesion(c, ["conv_id"]).withColumn("cohesion", F.round("cohesion", 6))


@query("largest_communities", with_sql(""", b AS (SELECT source_id AS node, target_id AS neighbour, weight FROM edges UNION ALL SELECT target_id, source_id, weight FROM edges), own AS (SELECT node, node AS neighbour, max(weight) AS weight FROM b GROUP BY node), k AS (SELECT node, neighbour, max(weight) AS weight FROM b GROUP BY ALL UNION ALL SELECT * FROM own),
r AS (SELECT node, node AS community, NULL::varchar AS was, NULL::varchar AS earlier, true AS moves FROM own UNION ALL
  SELECT *, bool_or(community IS DISTINCT FROM was) OVER () AND bool_or(community IS DISTINCT FROM earlier) OVER () AS moves FROM (
    SELECT l.node, l.community, r.community AS was, r.was AS earlier FROM (
      SELECT node, community FROM (SELECT k.node, r.community, round(sum(k.weight), 6) AS votes FROM k JOIN r ON r.node = k.neighbour WHERE r.moves GROUP BY k.node, r.community)
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, community) = 1) l JOIN r ON r.node = l.node)),
l AS (SELECT node, least(community, was) AS community FROM r WHERE NOT moves)
SELECT community, count(*) AS n, min(node) AS first FROM l GROUP BY community HAVING count(*) >= 3 ORDER BY n DESC, first LIMIT 10""", "edges", recursive=True))
def largest_communities(spark, d):
    c = mn.communities(ad.edges(spark, d)).groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    return c.where("n >= 3").orderBy(F.desc("n"), "first").limit(10)


_ENTITIES = ["small", "blue", "gear"]


@query("capped_entities", with_sql(f""", h AS (SELECT node_id, list_intersect(string_split(content, ' '), {_ENTITIES}) AS e FROM nodes), n AS (SELECT node_id, e, row_number() OVER (ORDER BY node_id) AS i FROM h WHERE len(e) > 0),
l AS (SELECT count(*) AS n, list(e ORDER BY i) AS es FROM n), r AS (SELECT 0::bigint AS a, list_transform(es, lambda x: 0) AS deg, []::bigint[] AS sel FROM l
UNION ALL SELECT a, list_transform(range(1, n + 1), lambda i: deg[i] + list_contains(sel, i)::int + CASE WHEN i = a THEN len(sel) ELSE 0 END), sel FROM (SELECT r.a + 1 AS a, r.deg, l.n,
  list_slice(list_filter(range(r.a + 2, l.n + 1), lambda b: r.deg[b] < 12 AND list_has_any(es[r.a + 1], es[b])), 1, greatest(12 - r.deg[r.a + 1], 0)) AS sel FROM r, l WHERE r.a < l.n))
SELECT x.node_id AS source_id, y.node_id AS target_id, 0.4::double AS weight FROM (SELECT a, unnest(sel) AS b FROM r) JOIN n x ON x.i = a JOIN n y ON y.i = b""", "nodes", recursive=True))
def capped_entities(spark, d):
    n = ad.nodes(spark, d).select("layer", "node_id", F.split("content", " ").alias("words"))
    return up.shared_entities(n, _ENTITIES, 12).select("source_id", "target_id", "weight")


# -- vectors and the rest -----------------------------------------------------------------


@query("weighted_hamming", """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings), q AS (SELECT b AS qb FROM b WHERE vec_id = 0), w AS (SELECT list_transform(range(0, 64), lambda i: 1 + i % 7) AS w)
SELECT vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b[i] <> qb[i] THEN w[i] ELSE 0 END)) / list_sum(w), 6) AS score FROM b, q, w""")
def weighted_hamming(spark, d):
    v = ad.vectors(spark, d)
    ones = lambda c: F.transform(c, lambda x: (x > 0).cast("int"))
    q = F.broadcast(v.where("vec_id = 0").select(ones("embedding").alias("_q")))
    w = F.array(*[F.lit(1 + i % 7) for i in range(64)])
    from ..functions import scoring as sc

    return v.crossJoin(q).select("vec_id", F.round(sc.weighted_hamming(ones("embedding"), F.col("_q"), w), 6).alias("score"))


@query("binary_by_thresholds", "WITH t AS (SELECT list_transform(range(0, 64), lambda i: (i - 32) / 400) AS t) SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i]::double > t[i] THEN 1 ELSE 0 END))::int AS ones FROM embeddings, t")
def binary_by_thresholds(spark, d):
    from ..functions import scoring as sc

    t = F.array(*[F.lit((i - 32) / 400) for i in range(64)])
    bits = sc.binary_words(F.col("embedding"), t)
    return ad.vectors(spark, d).select("vec_id", F.aggregate(bits, F.lit(0), lambda a, x: a + F.bit_count(x)).alias("ones"))


@query("learned_thresholds", """WITH p AS (SELECT a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), d AS (SELECT i AS dim, a[i + 1]::double AS x, b[i + 1]::double AS y FROM p, (SELECT unnest(range(0, 64)) AS i)),
r AS (SELECT dim, least(min(x), min(y)) AS lo, greatest(max(x), max(y)) AS hi FROM d GROUP BY dim), c AS (SELECT dim, k, lo + (hi - lo) * k / 9 AS t FROM r, (SELECT unnest(range(0, 10)) AS k)),
s AS (SELECT c.dim, k, any_value(t) AS t, count_if((x > t) = (y > t)) AS agree FROM c JOIN d USING (dim) GROUP BY c.dim, k) SELECT dim::int AS dim, k::int AS k, round(t, 5) AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY dim ORDER BY agree DESC, k) = 1""")
def learned_thresholds(spark, d):
    from ..functions import scoring as sc

    v = ad.vectors(spark, d).select("vec_id", "embedding")
    pairs = v.where("vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("a")).join(v.withColumnRenamed("embedding", "b"), "vec_id")
    return sc.learned_thresholds(pairs, 10).select("dim", "k", F.round("threshold", 5).alias("threshold"))


@query("centring_ratio", """WITH m AS (SELECT i, avg(embedding[i]::double) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i), n AS (SELECT median(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))) AS n FROM embeddings) SELECT round(sqrt(sum(m * m)) / any_value(n), 6) AS ratio FROM m, n""")
def centring_ratio(spark, d):
    """The length of the mean vector against the median length: from 0.7 on vectors should be centred before their signs are taken."""
    from ..operators import aggregates as ag

    v = ad.vectors(spark, d)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    middle = ag.median(v, norm)
    mean = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))) / F.lit(middle), 6).alias("ratio"))


@query("fact_cover", """WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings WHERE vec_id % 10 = 1), f AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id % 10 = 2), m AS (SELECT e.vec_id, max(round(list_cosine_similarity(e.v, f.v), 6)) AS best FROM e, f GROUP BY e.vec_id) SELECT round(avg(best), 5) AS cover, count(*) AS n FROM m""")
def fact_cover(spark, d):
    """Mean over episodes of the cosine to the nearest fact, in blocks."""
    from ..operators import retrieval as rt

    v = ad.vectors(spark, d).select("vec_id", "embedding")
    best = rt.cosine_search(v.where("vec_id % 10 = 2"), v.where("vec_id % 10 = 1").withColumnRenamed("vec_id", "query_id"), 1)
    return best.agg(F.round(F.avg("score"), 5).alias("cover"), F.count("*").alias("n"))


@query("scaled_scores", with_sql(" SELECT log_id, round(CASE WHEN max(value - 40) OVER w > 0 THEN greatest(0, value - 40) / max(value - 40) OVER w ELSE 0 END, 6) AS score FROM audit WINDOW w AS (PARTITION BY user_id)", "audit"))
def scaled_scores(spark, d):
    from pyspark.sql import Window

    from ..functions import scoring as sc

    return ad.audit(spark, d).select("log_id", F.round(sc.floored(F.col("value") - 40, Window.partitionBy("user_id")), 6).alias("score"))


@query("conversation_values", with_sql(" SELECT user_id, count(*) AS n, round(avg(importance), 6) AS mean, count(DISTINCT memory_kind) AS kinds FROM facts GROUP BY user_id", "facts"))
def conversation_values(spark, d):
    return ad.facts(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("mean"), F.count_distinct("memory_kind").alias("kinds"))


@query("json_fields", with_sql(" SELECT event_id AS log_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, len(json_keys(props))::int AS n FROM events", "audit"))
def json_fields(spark, d):
    e = ad.table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.from_json("props", "map<string,string>").alias("m"))
    return e.select("log_id", F.coalesce(F.try_element_at("m", F.lit("k")), F.lit("none")).alias("k"), F.size("m").alias("n"))


@query("stacked_tags", with_sql(", a AS (SELECT entry_id, list_distinct(list_concat(['k:' || memory_kind], ['u:' || user_id, 'k:' || memory_kind])) AS t FROM facts) SELECT entry_id, len(t)::int AS n FROM a", "facts"))
def stacked_tags(spark, d):
    f = ad.facts(spark, d).withColumn("tags", F.array(F.concat(F.lit("k:"), "memory_kind")))
    out = up.add_tag(up.add_tag(f, F.concat(F.lit("u:"), "user_id")), F.concat(F.lit("k:"), "memory_kind"))
    return out.select("entry_id", F.size("tags").alias("n"))


@query("audit_facts", with_sql(" SELECT a.log_id, f.entry_id FROM audit a JOIN facts f ON try_cast(a.target_id AS bigint) = f.entry_id", "audit", "facts"))
def audit_facts(spark, d):
    a = ad.audit(spark, d).select("log_id", F.col("target_id").try_cast("long").alias("entry_id"))
    return a.join(ad.facts(spark, d).select("entry_id"), "entry_id").select("log_id", "entry_id")


@query("daily_brief", with_sql(f", p AS (SELECT 'facts' AS section, count(*) AS n, max(created_at) AS last FROM facts WHERE created_at > {THEN} UNION ALL SELECT 'episodes', count(*), max(created_at) FROM episodes WHERE created_at > {NOW} - 10 * {DAY} UNION ALL SELECT 'audit', count(*), max(ts) FROM audit WHERE ts > 1704067200) SELECT * FROM p", "facts", "episodes", "audit"))
def daily_brief(spark, d):
    part = lambda df, name, at, since: df.where(F.col(at) > since).agg(F.lit(name).alias("section"), F.count("*").alias("n"), F.max(at).alias("last"))
    a = part(ad.facts(spark, d), "facts", "created_at", THEN)
    return a.unionByName(part(ad.episodes(spark, d), "episodes", "created_at", NOW - 10 * DAY)).unionByName(part(ad.audit(spark, d), "audit", "ts", 1_704_067_200))


@query("valence_of_facts", with_sql(", v AS (SELECT target_id, CASE WHEN length(source_id) % 3 = 0 THEN 'contradicts' WHEN length(source_id) % 3 = 1 THEN 'supports' ELSE 'other' END AS r FROM edges) SELECT target_id, CASE WHEN bool_or(r = 'contradicts') THEN 'contrasting' WHEN bool_or(r = 'supports') THEN 'supporting' ELSE 'neutral' END AS valence FROM v GROUP BY target_id", "edges"))
def valence_of_facts(spark, d):
    n = F.length("source_id") % 3
    e = ad.edges(spark, d).withColumn("relation", F.when(n == 0, "contradicts").when(n == 1, "supports").otherwise("other"))
    return gr.valence(e)


@query("path_exists", with_sql(" SELECT 's1' AS origin, 1 AS hops WHERE EXISTS (SELECT 1 FROM edges WHERE source_id = 's1' AND target_id = (SELECT min(target_id) FROM edges WHERE source_id = 's1'))", "edges"))
def path_exists(spark, d):
    e = ad.edges(spark, d)
    target = e.where("source_id = 's1'").agg(F.min("target_id")).first()[0]
    return gr.reaches(e, spark.createDataFrame([("s1",)], "node string"), target, 2) if target else spark.createDataFrame([], "origin string, hops int")


@query("activation_of_targets", with_sql(f", g AS (SELECT target_id, count(*) AS n, max(ts) AS last FROM audit GROUP BY target_id) SELECT target_id, round({_ACT.format(n='n', now=NOW, last='last')}, 6) AS activation, round(1 / (1 + exp(-(n - 3))), 6) AS sure FROM g", "audit"))
def activation_of_targets(spark, d):
    from ..functions import scoring as sc

    g = ad.audit(spark, d).groupBy("target_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.select("target_id", F.round(sc.actr(F.lit(NOW), F.col("last"), F.col("n")), 6).alias("activation"), F.round(sc.sigmoid(F.col("n") - 3), 6).alias("sure"))


# -- stores -------------------------------------------------------------------------------


@query("branch_counts", fx(" SELECT 'user@' || b AS layer, count(*) AS n FROM fx, (VALUES ('draft')) t(b) WHERE layer = 'user' AND user_id = 'u3' GROUP BY b"))
def branch_counts(spark, d):
    return st.branches(st.create_branch(facts_x(spark, d), "user", "u3", "draft"))


_BRANCH = "ub AS (SELECT user_id, key, value, 'user' AS layer FROM l WHERE entry_id % 3 > 0 UNION ALL SELECT user_id, key, CASE WHEN entry_id % 2 = 0 THEN 'new ' || value ELSE value END, 'user@draft' FROM l WHERE entry_id % 5 > 0)"


@query("merged_branch", with_sql(f", {_LAST}, {_BRANCH}, b AS (SELECT * FROM ub WHERE layer = 'user@draft'), m AS (SELECT * FROM ub WHERE layer = 'user') SELECT coalesce(m.user_id, b.user_id) AS user_id, coalesce(m.key, b.key) AS key, coalesce(b.value, m.value) AS value FROM m FULL JOIN b ON m.user_id = b.user_id AND m.key = b.key", "facts"))
def merged_branch(spark, d):
    f = _latest(spark, d)
    m = f.where("entry_id % 3 > 0").select("user_id", "key", "value", F.lit("user").alias("layer"))
    b = f.where("entry_id % 5 > 0").select("user_id", "key", F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("new "), "value")).otherwise(F.col("value")).alias("value"), F.lit("user@draft").alias("layer"))
    return st.merge_branch(m.unionByName(b), "user", "draft")


@query("snapshot_rows", with_sql(f", {_LAST} SELECT entry_id, value FROM l WHERE entry_id % 2 = 0", "facts"))
def snapshot_rows(spark, d):
    f = _latest(spark, d).select("entry_id", "user_id", "key", "value")
    store = st.snapshot(f, ["user_id", "key"], "a", 1).unionByName(st.snapshot(f.where("entry_id % 2 = 0"), ["user_id", "key"], "a", 2))
    return st.from_snapshot(store, "a", "entry_id long, user_id string, key string, value string").select("entry_id", "value")


@query("fetched_after", with_sql(" SELECT log_id, (SELECT max(log_id) FROM audit) AS cursor FROM audit WHERE log_id > 100 AND action = 'click' ORDER BY log_id LIMIT 30", "audit"))
def fetched_after(spark, d):
    a = ad.audit(spark, d)
    return st.fetch_after(a, "log_id", 100, 30, F.col("action") == "click").select("log_id").crossJoin(st.latest(a, "log_id"))


@query("cached_vectors", with_sql(" SELECT id, sha256(regexp_replace(regexp_replace(trim(lower(text)), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS text_hash, bool_or(id % 3 = 0) OVER (PARTITION BY regexp_replace(regexp_replace(trim(lower(text)), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS hit FROM journal", "journal"))
def cached_vectors(spark, d):
    j = ad.journal(spark, d).select("id", "text")
    cache = j.where("id % 3 = 0").select(F.sha2(st.normal_text(F.col("text")), 256).alias("text_hash"), F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("embedding"))
    return st.cached(j, cache, "m").select("id", "text_hash", F.col("embedding").isNotNull().alias("hit"))


@query("shortened_logs", with_sql(""", r AS (SELECT id, string_split(replace(text, ' ', chr(10)), chr(10)) AS l FROM journal), k AS (SELECT id, list_concat(CASE WHEN trim(l[1]) <> '' THEN [l[1]] ELSE [] END, list_filter(l[2:], lambda x: contains(x, 'error') OR contains(x, 'fail') OR contains(x, 'warn') OR contains(x, 'assert') OR contains(x, 'fatal') OR contains(x, 'panic'))) AS k FROM r)
SELECT id, len(list_filter(range(1, len(k) + 1), lambda i: i = 1 OR k[i] <> k[i - 1]))::int AS n FROM k""", "journal"))
def shortened_logs(spark, d):
    short = st.shortened_log(F.replace("text", F.lit(" "), F.lit("\n")), 10_000)
    return ad.journal(spark, d).select("id", F.when(short == "", 0).otherwise(F.size(F.split(short, "\n"))).alias("n"))


@query("identity_chunks", "WITH p AS (SELECT s_suppkey AS id, 'opening of ' || s_name || ' ' || repeat('x', 20) || chr(10) || '## One' || chr(10) || repeat('y', 40) || chr(10) || '## Two' || chr(10) || 'short' AS t FROM supplier) SELECT id, 0 AS place, 'opening of ' || s_name || ' ' || repeat('x', 20) AS heading FROM p JOIN supplier ON id = s_suppkey UNION ALL SELECT id, 1, 'One' FROM p")
def identity_chunks(spark, d):
    s = ad.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("opening of "), "s_name", F.lit(" " + "x" * 20 + "\n## One\n" + "y" * 40 + "\n## Two\nshort")).alias("t"))
    return st.identity_chunks(s, "id", "t").select("id", "place", "heading")
