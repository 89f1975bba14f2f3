"""Named queries over the given tables, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import scoring as sc
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import joins as jn
from ..operators import lifecycle as lc
from ..operators import privacy as pv
from ..operators import retrieval as rt
from ..operators import windows as wn
from ..sources import adapters as ad
from ..sources.adapters import DAY, NOW, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Some day in 1998, a clock for tables of orders.
THEN = 899_251_200


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ASKED = [("q1", "the customer#00000001 order high with"), ("q2", "thing the in customer#00000002")]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id string, query string")


_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ASKED) + ") t(query_id, query))"
_BM25 = """
docs_w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs_w),
post AS (SELECT doc_id, any_value(len(w)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM docs_w) GROUP BY doc_id, term),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\pL\\pN]+')) AS term FROM asked),
hit AS (SELECT qt.query_id, post.* FROM post JOIN qt ON post.term = qt.term),
dfs AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY ALL),
bm AS (SELECT h.query_id, doc_id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) AS score
  FROM hit h JOIN dfs ON h.query_id = dfs.query_id AND h.term = dfs.term, st GROUP BY ALL)"""


def _bm25(spark, d):
    index, stats = rt.asked_postings(ad.table(spark, d, "documents"), "doc_id", asked(spark), "text")
    return rt.bm25(index, stats, asked(spark), "doc_id")


@query("bm25_search", f"WITH {_ASKED}, {_BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_search(spark, d):
    return _bm25(spark, d).withColumn("score", F.round("score", 6))


@query("reciprocal_rank_fusion", f"""WITH {_ASKED}, {_BM25},
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS r FROM bm),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) - 1 AS r FROM (SELECT query_id, doc_id, sum(tf) AS n FROM hit GROUP BY ALL)),
u AS (SELECT *, 'bm25' AS f FROM a UNION ALL SELECT *, 'count' FROM b)
SELECT query_id, doc_id, round(sum(1.0::double / (61 + r)), 6) AS score, string_agg(f, '+' ORDER BY f) AS found_by FROM u GROUP BY query_id, doc_id""")
def reciprocal_rank_fusion(spark, d):
    index, stats = rt.asked_postings(ad.table(spark, d, "documents"), "doc_id", asked(spark), "text")
    best = rt.bm25(index, stats, asked(spark), "doc_id").withColumn("score", F.round("score", 6))
    terms = asked(spark).select("query_id", F.explode(tx.tokens(F.col("query"), 1)).alias("term"))
    count = index.join(F.broadcast(terms), "term").groupBy("query_id", "doc_id").agg(F.sum("tf").alias("score"))
    return wn.reciprocal_ranks({"bm25": best, "count": count}, ["query_id"], "doc_id").withColumn("score", F.round("score", 6))


@query("dream_recall", with_sql(f""", {_ASKED}, {_BM25},
words AS (SELECT query_id, word FROM (SELECT query_id, unnest(string_split(lower(query), ' ')) AS word FROM asked) WHERE length(word) >= 3),
core AS (SELECT query_id, 'core' AS source, entry_id AS native_id, max(importance * 1.0::double) AS score, max(created_at) AS created_at FROM facts JOIN words ON contains(lower(key || ' ' || value), word) GROUP BY query_id, entry_id),
epi AS (SELECT query_id, 'episodic' AS source, episode_id AS native_id, max(weight) AS score, max(created_at) AS created_at FROM episodes JOIN words ON contains(lower(summary), word) GROUP BY query_id, episode_id),
rag AS (SELECT query_id, 'rag' AS source, doc_id AS native_id, round(score, 6) AS score, {NOW} - doc_id * 3600 AS created_at FROM bm),
pool AS (SELECT * FROM (SELECT * FROM core UNION ALL SELECT * FROM epi UNION ALL SELECT * FROM rag) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 6) DESC, native_id) <= 20),
mm AS (SELECT *, min(score) OVER (PARTITION BY query_id, source) AS lo, max(score) OVER (PARTITION BY query_id, source) AS hi FROM pool),
sc AS (SELECT query_id, source, native_id, CASE WHEN hi - lo < 1e-12 THEN 1.0::double ELSE (score - lo) / (hi - lo) END * (1 + 0.5::double * pow(0.5::double, greatest({NOW} - created_at, 0) / 86400 / 30)) AS score FROM mm)
SELECT query_id, source, native_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, source, native_id) AS place FROM sc QUALIFY place <= 10""", "facts", "episodes"))
def dream_recall(spark, d):
    """Hybrid recall: documents by BM25, facts and episodes by words, merged by scaled score and recency."""
    q = asked(spark)
    rag = _bm25(spark, d).select("query_id", F.lit("rag").alias("source"), F.col("doc_id").alias("native_id"), F.round("score", 6).alias("score"), (F.lit(NOW) - F.col("doc_id") * 3600).alias("created_at"))
    found = rt.recall([rt.core_hits(ad.facts(spark, d), q), rt.episode_hits(ad.episodes(spark, d), q), rag], NOW, 10)
    return found.select("query_id", "source", "native_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("filter_facts", with_sql(f""" SELECT entry_id, user_id, key, value, round(importance, 6) AS importance, created_at FROM facts
WHERE importance >= 0.5 AND contains(lower(key), '0000001') AND contains(lower(value), 'high') AND created_at >= 820454400 AND created_at < {THEN} ORDER BY created_at DESC, entry_id DESC LIMIT 50""", "facts"))
def filter_facts(spark, d):
    rows = fl.query_memory(ad.facts(spark, d), importance_min=0.5, key_like="0000001", content_like="HIGH", created_since=820454400, created_until=THEN)
    return rows.select("entry_id", "user_id", "key", "value", F.round("importance", 6).alias("importance"), "created_at")


@query("facet_filter", with_sql(" SELECT episode_id, weight, created_at FROM episodes WHERE (list_contains(tags, 'lang:en') OR list_contains(tags, 'lang:de')) AND list_contains(tags, 'src:src3') ORDER BY created_at DESC, episode_id DESC LIMIT 200", "episodes"))
def facet_filter(spark, d):
    return fl.query_memory(ad.episodes(spark, d), "episodes", tags=["lang:en", "src:src3", "lang:de", "lang:en"], limit=500).select("episode_id", "weight", "created_at")


@query("token_search", with_sql(""", m AS (SELECT entry_id, importance, contains(lower(key || ' ' || value), 'urgent')::int + contains(lower(key || ' ' || value), '00042')::int AS matches FROM facts),
f AS (SELECT * FROM m WHERE matches > 0 ORDER BY importance DESC, entry_id DESC LIMIT 100)
SELECT entry_id, matches, round(importance, 6) AS importance FROM f ORDER BY matches DESC, importance DESC, entry_id DESC LIMIT 10""", "facts"))
def token_search(spark, d):
    return fl.token_search(ad.facts(spark, d), "URGENT 00042").select("entry_id", "matches", F.round("importance", 6).alias("importance"))


@query("expired_facts", with_sql(f", e AS (SELECT *, CASE WHEN needs_expiry THEN created_at + 30 * {DAY} END AS expires_at FROM facts JOIN kinds USING (memory_kind)) SELECT entry_id, CASE WHEN expires_at < {THEN} THEN '[EXPIRED] ' || value ELSE value END AS shown FROM e WHERE memory_kind = 'goal'", "facts", "kinds"))
def expired_facts(spark, d):
    f = ad.facts(spark, d).join(policy.kinds(spark), "memory_kind").where("memory_kind = 'goal'")
    expires = F.when(F.col("needs_expiry"), F.col("created_at") + 30 * DAY)
    return f.select("entry_id", fl.mark_expired(F.col("value"), expires, THEN).alias("shown"))


@query("archive_candidates", with_sql(f""", e AS (SELECT f.*, k.needs_expiry, k.never_archive, CASE WHEN needs_expiry THEN created_at + 30 * {DAY} END AS expires_at FROM facts f JOIN kinds k ON f.memory_kind = k.memory_kind)
SELECT entry_id, 0 AS prio FROM e WHERE needs_expiry AND NOT never_archive AND expires_at < {THEN}
UNION ALL SELECT entry_id, 1 FROM e WHERE NOT never_archive AND importance < 0.3 AND created_at < {THEN} - 90 * {DAY} AND NOT (needs_expiry AND coalesce(expires_at, {THEN}) < {THEN})""", "facts", "kinds"))
def archive_candidates(spark, d):
    goal = F.when(F.col("memory_kind") == "goal", F.col("created_at") + 30 * DAY)
    return fl.archivable(ad.facts(spark, d).withColumn("expires_at", goal), policy.kinds(spark), THEN).select("entry_id", "prio")


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\pL\\pN]+'), lambda x: length(x) >= 3))"


@query("verified_hits", f"SELECT doc_id FROM documents WHERE len(list_intersect(list_filter({_TOKENS.format(c='text')}, lambda x: NOT list_contains([{_STOP}], x)), ['andtion', 'thstre', 'ander'])) > 0")
def verified_hits(spark, d):
    return fl.verified(ad.table(spark, d, "documents").select("doc_id", "text"), "the andtion, thstre with Ander", "text").select("doc_id")


RULES = [("toxic", 0.2, ["idiot", "stupid"], ["tone:harsh"]), ("licence", 0.15, ["licensed", "released under"], ["legal", "tone:formal"]), ("long", 0.1, ["the and"], ["legal"])]


@query("rule_matches", """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (SELECT doc_id, contains(t, 'idiot') OR contains(t, 'stupid') AS a, contains(t, 'licensed') OR contains(t, 'released under') AS b, contains(t, 'the and') AS c FROM t)
SELECT doc_id, (a::int + b::int + c::int) AS n_rules, round(least(0.3, CASE WHEN a THEN 0.2 ELSE 0 END + CASE WHEN b THEN 0.15 ELSE 0 END + CASE WHEN c THEN 0.1 ELSE 0 END)::double, 6) AS boost, (a::int + (b OR c)::int + b::int) AS n_tags FROM h WHERE a OR b OR c""")
def rule_matches(spark, d):
    m = fl.matching_rules(ad.table(spark, d, "documents").select("doc_id", "text"), RULES)
    return m.where(F.size("rules") > 0).select("doc_id", F.size("rules").alias("n_rules"), F.round("boost", 6).alias("boost"), F.size("rule_tags").alias("n_tags"))


@query("token_sets", f"SELECT doc_id, len({_TOKENS.format(c='text')})::int AS n_tokens, list_sort({_TOKENS.format(c='text')})[1] AS least_token FROM documents")
def token_sets(spark, d):
    t = tx.tokens(F.col("text"))
    return ad.table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_min(t).alias("least_token"))


@query("text_measures", """WITH p AS (SELECT id, text, list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s) <> '') AS parts FROM journal)
SELECT id, (length(text) // 4)::bigint AS est_tokens, substr(array_to_string(list_transform(parts[1:2], lambda s: trim(s)), '. '), 1, 400) AS preview, contains(text, '?') AS question,
CASE WHEN regexp_matches(lower(text), '(^|[^\\pL\\pN_])(все(х|м|е|ё)?|список|enumerate)($|[^\\pL\\pN_])|перечисл|list\\s+all') THEN 'enumerative' WHEN regexp_matches(lower(text), 'почему|из-за|привело|влияет|цепочк|поэтому|следств') OR len(string_split_regex(trim(text, ' \n\t'), '\\s+')) >= 10 THEN 'multi_hop' ELSE 'factual' END AS query_class FROM p""".replace("WITH p", "WITH " + ad.SQL["journal"] + ", p"))
def text_measures(spark, d):
    t = F.col("text")
    return ad.journal(spark, d).select("id", tx.estimate_tokens(t).alias("est_tokens"), tx.preview(t).alias("preview"), t.contains("?").alias("question"), tx.classify_query(t).alias("query_class"))


@query("structure_scores", with_sql(f""", s AS (SELECT id, text AS t, contains(text, '?') AS q, regexp_matches(lower(text), '{"|".join(tx.KEYWORDS)}') AS k FROM journal)
SELECT id, round(CASE WHEN length(t) < 20 THEN 0 ELSE least(1, CASE WHEN length(t) > 100 THEN 0.2 ELSE 0 END + CASE WHEN q THEN 0.15 ELSE 0 END + CASE WHEN contains(t, '!') THEN 0.1 ELSE 0 END + CASE WHEN k THEN 0.2 ELSE 0 END + CASE WHEN len(string_split(t, chr(10))) >= 3 THEN 0.15 ELSE 0 END + CASE WHEN q AND k THEN 0.1 ELSE 0 END) END::double, 6) AS score FROM s""", "journal"))
def structure_scores(spark, d):
    return ad.journal(spark, d).select("id", F.round(tx.structure_score(F.col("text")), 6).alias("score"))


@query("privacy_counts", f"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '{pv.EMAIL}', ' ', 'g') AS b FROM documents), c AS (SELECT *, regexp_replace(b, '{pv.IP}', ' ', 'g') AS r FROM a)
SELECT doc_id, len(regexp_extract_all(text, '{pv.EMAIL}'))::int AS emails, len(regexp_extract_all(b, '{pv.IP}'))::int AS ips, len(regexp_extract_all(r, '{pv.PHONE}'))::int AS phones FROM c""")
def privacy_counts(spark, d):
    counts = pv.personal_counts(ad.table(spark, d, "documents"), "text", "doc_id")
    return counts.select("doc_id", *[F.col(k).cast("int").alias(k) for k in ("emails", "ips", "phones")])


def _sql_redact() -> str:
    out = "text"
    for p in pv.CREDENTIALS:
        out = f"regexp_replace({out}, '{p}', '[REDACTED]', 'g')"
    return out


@query("redacted_texts", f"SELECT doc_id, length({_sql_redact()})::int AS n_chars, contains({_sql_redact()}, '[REDACTED]') AS redacted FROM documents")
def redacted_texts(spark, d):
    clean = pv.strip_secrets(F.col("text"))
    return ad.table(spark, d, "documents").select("doc_id", F.length(clean).alias("n_chars"), clean.contains("[REDACTED]").alias("redacted"))


@query("chunked_documents")
def chunked_documents(spark, d):
    c = ad.table(spark, d, "documents").select("doc_id", F.posexplode(tx.chunks()(F.col("text"))).alias("chunk_index", "content"))
    return c.select("doc_id", "chunk_index", F.length("content").alias("n_chars"))


@query("atoms", with_sql(" SELECT id, len(list_filter(list_transform(string_split_regex(text, '\\n+'), lambda s: trim(s)), lambda s: length(s) >= 15)[1:10])::int AS n FROM (SELECT id, regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g') AS text FROM journal)", "journal"))
def atoms(spark, d):
    return ad.journal(spark, d).select("id", F.size(tx.atoms(F.col("text"))).alias("n"))


# -- windows and joins ----------------------------------------------------------------------


@query("user_sessions", with_sql(""", g AS (SELECT *, coalesce((ts - lag(ts) OVER w > 1800)::int, 1) AS new FROM audit WINDOW w AS (PARTITION BY user_id ORDER BY ts, log_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS n FROM g) SELECT user_id, n::bigint AS session_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events FROM s GROUP BY user_id, n""", "audit"))
def user_sessions(spark, d):
    return wn.session_spans(ad.audit(spark, d), ["user_id"])


@query("session_quality", with_sql(""", g AS (SELECT *, coalesce((ts - lag(ts) OVER w > 1800)::int, 1) AS new FROM audit WINDOW w AS (PARTITION BY user_id ORDER BY ts, log_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS n FROM g), p AS (SELECT user_id, n, min(ts) AS a, max(ts) AS b, count(*) AS c FROM s GROUP BY ALL)
SELECT p.user_id, p.n::bigint AS session_no, (least(20, 4 * any_value(c)) + least(20, 5 * count_if(action = 'purchase')) + least(20, 5 * count(DISTINCT action)))::bigint AS quality FROM p JOIN audit ON audit.user_id = p.user_id AND ts BETWEEN a AND b GROUP BY p.user_id, p.n""", "audit"))
def session_quality(spark, d):
    """Capped components summed over the events that each session's interval holds."""
    events = ad.audit(spark, d)
    spans = wn.session_spans(events, ["user_id"])
    met = jn.in_interval(events, spans, ["user_id"], "ts", "start_ts", "end_ts")
    parts = F.least(F.lit(20), 4 * F.first("n_events")) + F.least(F.lit(20), 5 * F.count_if(F.col("action") == "purchase")) + F.least(F.lit(20), 5 * F.count_distinct("action"))
    return met.groupBy("user_id", "session_no").agg(parts.cast("long").alias("quality"))


@query("fact_intervals", with_sql(" SELECT entry_id, key, value, created_at AS valid_from, lead(created_at) OVER (PARTITION BY user_id, key ORDER BY created_at, entry_id) AS valid_to FROM facts", "facts"))
def fact_intervals(spark, d):
    return jn.intervals(ad.facts(spark, d), lc.SCOPE).select("entry_id", "key", "value", "valid_from", "valid_to")


@query("facts_at", with_sql(f", i AS (SELECT *, lead(created_at) OVER (PARTITION BY user_id, key ORDER BY created_at, entry_id) AS valid_to FROM facts) SELECT user_id, key, value, entry_id FROM i WHERE created_at <= {THEN} AND (valid_to IS NULL OR valid_to > {THEN}) QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, entry_id DESC) = 1", "facts"))
def facts_at(spark, d):
    return jn.value_at(jn.intervals(ad.facts(spark, d), lc.SCOPE), lc.SCOPE, THEN).select("user_id", "key", "value", "entry_id")


@query("as_of_join", with_sql(", e AS (SELECT log_id, user_id, ts, action, value FROM audit WHERE action = 'purchase'), v AS (SELECT user_id, ts, value FROM audit WHERE action = 'view') SELECT e.log_id, e.ts, v.value AS last_view FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts", "audit"))
def as_of_join(spark, d):
    a = ad.audit(spark, d)
    probes = a.where("action = 'purchase'").select("log_id", "user_id", "ts")
    views = a.where("action = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("last_view"))
    return jn.as_of(probes, views, ["user_id"], "ts", "view_ts", "last_view").select("log_id", "ts", "last_view")


@query("latest_facts", with_sql(" SELECT entry_id, user_id, key, value FROM facts QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, entry_id DESC) = 1", "facts"))
def latest_facts(spark, d):
    f = ad.facts(spark, d)
    return lc.upsert(f.where("entry_id % 2 = 0"), f.where("entry_id % 2 = 1")).select("entry_id", "user_id", "key", "value")


@query("fact_history", with_sql(""", h AS (SELECT *, lag(value) OVER (PARTITION BY user_id, key ORDER BY created_at, entry_id) AS old_value FROM facts)
SELECT entry_id, old_value, value AS new_value, sha256(user_id || '|' || key || '|' || value || '|' || created_at::varchar)[1:16] AS commit_hash FROM h WHERE old_value IS NULL OR old_value <> value""", "facts"))
def fact_history(spark, d):
    return lc.history(ad.facts(spark, d)).select("entry_id", "old_value", "new_value", "commit_hash")


@query("branch_diff", with_sql(f""", a AS (SELECT user_id, key, value FROM facts WHERE created_at <= {THEN} QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, entry_id DESC) = 1),
b AS (SELECT user_id, key, value FROM facts WHERE created_at > {THEN} - 200 * {DAY} QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, entry_id DESC) = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.value = b.value THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id AND a.key = b.key""", "facts"))
def branch_diff(spark, d):
    f = ad.facts(spark, d)
    order = (F.desc("created_at"), F.desc("entry_id"))
    return jn.compare(wn.latest(f.where(F.col("created_at") <= THEN), lc.SCOPE, *order), wn.latest(f.where(F.col("created_at") > THEN - 200 * DAY), lc.SCOPE, *order), lc.SCOPE, "value")


@query("rate_limits", with_sql(" SELECT log_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent, recent <= 3 AS allowed FROM audit", "audit"))
def rate_limits(spark, d):
    return wn.rate_limited(ad.audit(spark, d), ["user_id"], "ts", DAY, 3).select("log_id", "recent", "allowed")


@query("fading_threshold", with_sql(""" , n AS (SELECT log_id, user_id, value / 100 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, log_id) AS i FROM audit),
r(user_id, i, t) AS (SELECT user_id, i, 0.4::double FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, 0.9::double * r.t + 0.1::double * least(greatest(p.s, 0.1::double), 0.6::double) FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1 JOIN n p ON p.user_id = r.user_id AND p.i = r.i)
SELECT log_id, round(t, 6) AS threshold FROM r JOIN n ON r.user_id = n.user_id AND r.i = n.i""", "audit", recursive=True))
def fading_threshold(spark, d):
    a = ad.audit(spark, d).withColumn("s", F.col("value") / 100)
    return wn.fading_threshold(a, ["user_id"], ["ts", "log_id"], "s").select("log_id", F.round("threshold", 6).alias("threshold"))


@query("newest_entries", with_sql(" SELECT id, user_id FROM journal QUALIFY row_number() OVER (PARTITION BY user_id, layer ORDER BY ts DESC, id DESC) <= 5", "journal"))
def newest_entries(spark, d):
    return wn.newest(ad.journal(spark, d), ["user_id", "layer"], 5, F.desc("ts"), F.desc("id")).select("id", "user_id")


@query("journal_chain", with_sql(", h AS (SELECT id, layer, ts, sha256(raw_type || '|' || text || '|' || ts::varchar)[1:16] AS own FROM journal) SELECT id, own, coalesce(lag(own) OVER (PARTITION BY layer ORDER BY id), '') AS prev FROM h", "journal"))
def journal_chain(spark, d):
    own = F.substring(F.sha2(F.concat_ws("|", "raw_type", "text", F.col("ts").cast("string")), 256), 1, 16)
    return ad.journal(spark, d).select("id", own.alias("own"), F.coalesce(F.lag(own).over(Window.partitionBy("layer").orderBy("id")), F.lit("")).alias("prev"))


@query("duplicate_journal", with_sql(" SELECT min(id) AS id, sha256(layer || '|' || user_id || '|' || text) AS content_hash FROM journal GROUP BY 2", "journal"))
def duplicate_journal(spark, d):
    h = F.sha2(F.concat_ws("|", "layer", "user_id", "text"), 256)
    return ad.journal(spark, d).groupBy(h.alias("content_hash")).agg(F.min("id").alias("id")).select("id", "content_hash")


@query("stride_sample", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id FROM n WHERE i % 10 = 0")
def stride_sample(spark, d):
    """Every tenth row in order, without one task for all: rows are dealt to ranges of ids of even size by a sketch's
    quantiles, and numbers within a range follow those of the ranges before it."""
    docs = ad.table(spark, d, "documents").select("doc_id")
    cuts = docs.agg(F.percentile_approx("doc_id", [k / 200 for k in range(1, 200)], 10_000)).first()[0] or []
    ranged = docs.withColumn("r", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0))
    sizes = ranged.groupBy("r").agg(F.count("*").alias("n"))
    before = sizes.withColumn("off", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = ranged.withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy("doc_id")) - 1).join(F.broadcast(before), "r")
    return n.where((F.col("i") + F.col("off")) % 10 == 0).select("doc_id")


# -- aggregations ---------------------------------------------------------------------------


@query("table_counts", with_sql(" SELECT 'journal' AS name, count(*) AS n FROM journal UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'episodes', count(*) FROM episodes UNION ALL SELECT 'audit', count(*) FROM audit", "journal", "facts", "episodes", "audit"))
def table_counts(spark, d):
    made = {"journal": ad.journal, "facts": ad.facts, "episodes": ad.episodes, "audit": ad.audit}
    parts = [f(spark, d).agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, f in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("fact_stats", with_sql(" SELECT user_id, memory_kind, count(*) AS n, count_if(importance > 0.7)::bigint AS strong, count_if(importance < 0.3)::bigint AS weak, count(DISTINCT key) AS n_keys, round(avg(importance), 6) AS mean FROM facts GROUP BY ALL", "facts"))
def fact_stats(spark, d):
    i = F.col("importance")
    return ad.facts(spark, d).groupBy("user_id", "memory_kind").agg(F.count("*").alias("n"), F.count_if(i > 0.7).alias("strong"), F.count_if(i < 0.3).alias("weak"), F.count_distinct("key").alias("n_keys"), F.round(F.avg(i), 6).alias("mean"))


@query("usefulness_report", with_sql(" SELECT target_id, count_if(action = 'click')::bigint AS useful, count_if(action = 'error')::bigint AS useless, max(ts) AS last_ts FROM audit GROUP BY target_id", "audit"))
def usefulness_report(spark, d):
    return ag.usefulness(ad.audit(spark, d))


@query("rejection_summary", with_sql(" SELECT action, layer, count(*) AS n FROM (SELECT action, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'agent' END AS layer FROM audit) GROUP BY GROUPING SETS ((action), (layer), (action, layer), ())", "audit"))
def rejection_summary(spark, d):
    a = ad.audit(spark, d).select("action", F.when(F.col("user_id") % 2 == 0, "user").otherwise("agent").alias("layer"))
    return ag.rejections(a, "action", "layer")


@query("mad_threshold", with_sql(", m AS (SELECT median(weight) AS m FROM edges) SELECT round(any_value(m), 6) AS median, round(median(abs(weight - m)), 6) AS mad, round(any_value(m) - 1.5 * median(abs(weight - m)), 6) AS tau FROM edges, m", "edges"))
def mad_threshold(spark, d):
    return ag.mad_threshold(ad.edges(spark, d), "weight").select(*[F.round(c, 6).alias(c) for c in ("median", "mad", "tau")])


@query("distinguishing_words", """WITH t AS (SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS token FROM documents), s AS (SELECT *  FROM t WHERE length(token) >= 3),
nc AS (SELECT lang, count(DISTINCT doc_id) AS nc FROM s GROUP BY lang), n AS (SELECT count(DISTINCT doc_id) AS n FROM s), df AS (SELECT token, count(DISTINCT doc_id) AS df FROM s GROUP BY token), tf AS (SELECT lang, token, count(DISTINCT doc_id) AS tf FROM s GROUP BY lang, token)
SELECT tf.lang, tf.token, tf, round((tf / nc) / (df / n), 6) AS ratio, row_number() OVER (PARTITION BY tf.lang ORDER BY (tf / nc) / (df / n) DESC, tf DESC, tf.token) AS place FROM tf JOIN nc ON tf.lang = nc.lang JOIN df ON df.token = tf.token, n WHERE tf >= 0.1::double * nc QUALIFY place <= 3""")
def distinguishing_words(spark, d):
    t = ad.table(spark, d, "documents").select("lang", tx.tokens(F.col("text")).alias("tokens"))
    return ag.distinguishing(t, "lang", "tokens").select("lang", "token", "tf", F.round("ratio", 6).alias("ratio"), F.col("place").cast("long").alias("place"))


@query("top_words", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS word FROM documents) WHERE length(word) >= 4 GROUP BY word ORDER BY n DESC, word LIMIT 10")
def top_words(spark, d):
    return ag.top_words(ad.table(spark, d, "documents"))


@query("source_diversity", "WITH p AS (SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS t FROM documents GROUP BY lang, source) SELECT lang, round(1 / sum((n / t) * (n / t)), 6) AS n_eff FROM p GROUP BY lang")
def source_diversity(spark, d):
    n = ad.table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    return p.groupBy("lang").agg(F.round(sc.hill(F.col("p")), 6).alias("n_eff"))


@query("ndcg", f"WITH {_ASKED}, {_BM25}, r AS (SELECT bm.query_id, row_number() OVER (PARTITION BY bm.query_id ORDER BY round(score, 6) DESC, bm.doc_id) AS p, coalesce(quality, 0) AS rel FROM bm LEFT JOIN labels l ON bm.doc_id = l.doc_id), " "g AS (SELECT query_id, sum(rel / log2(p + 1)) AS gain, sum(rel) AS hits FROM r WHERE p <= 5 GROUP BY query_id) SELECT query_id, round(gain / (1 + 1 / log2(3) + 0.5 + 1 / log2(5) + 1 / log2(6)), 6) AS ndcg, hits::bigint AS hits FROM g")
def ndcg(spark, d):
    best = wn.newest(_bm25(spark, d), ["query_id"], 5, F.desc(F.round("score", 6)), F.asc("doc_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id"))
    r = best.withColumn("p", place).join(ad.table(spark, d, "labels"), "doc_id", "left").withColumn("rel", F.coalesce("quality", F.lit(0)))
    ideal = F.lit(1.0) + 1 / F.log2(F.lit(3.0)) + 0.5 + 1 / F.log2(F.lit(5.0)) + 1 / F.log2(F.lit(6.0))
    return r.groupBy("query_id").agg(F.round(sc.ndcg(F.col("rel"), F.col("p")) / ideal, 6).alias("ndcg"), F.sum("rel").alias("hits"))


# -- vectors --------------------------------------------------------------------------------

_BITS = "bits AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings)"
_DIST = "list_sum(list_transform(list_zip(v.b, q.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))"


def _query_bits(spark, d):
    return rt.bits_of(ad.vectors(spark, d).where("vec_id % 50 = 0")).select(F.col("vec_id").alias("query_id"), F.col("bits").alias("qbits"))


@query("binary_search", f"WITH {_BITS}, s AS (SELECT q.vec_id AS query_id, v.vec_id, {_DIST}::bigint AS distance FROM bits v, bits q WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, distance, round(1 - distance / 64, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10")
def binary_search(spark, d):
    return rt.binary_search(rt.bits_of(ad.vectors(spark, d)), _query_bits(spark, d)).withColumn("score", F.round("score", 6))


@query("bit_weights", f"WITH {_BITS}, p AS (SELECT unnest(range(0, 64)) AS position), s AS (SELECT position, sum(b[position + 1]) AS ones, count(*) AS n FROM bits, p GROUP BY position) SELECT position::int AS position, round(greatest(-ln((ones + 1) / (n + 2)), 0.1), 6) AS weight FROM s")
def bit_weights(spark, d):
    return ag.bit_weights(rt.bits_of(ad.vectors(spark, d))).select("position", F.round("weight", 6).alias("weight"))


@query("cosine_search", "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) SELECT query_id, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) <= 5")
def cosine_search(spark, d):
    v = ad.vectors(spark, d).select("vec_id", "embedding")
    return rt.cosine_search(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query("int8_vectors", "WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::double))) AS t FROM embeddings) SELECT vec_id, round(t, 6) AS scale, list_sum(list_transform(embedding, lambda x: round(x::double / t * 127)))::bigint AS total FROM m")
def int8_vectors(spark, d):
    scale, q = sc.int8(F.col("embedding"))
    return ad.vectors(spark, d).select("vec_id", F.round(scale, 6).alias("scale"), F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("alike_bits", f"""WITH {_BITS}, s AS (SELECT v.vec_id AS a, q.vec_id AS b, list_sum(list_transform(list_zip(v.b, q.b), lambda z: z[1] * z[2])) AS both_n, list_sum(list_transform(list_zip(v.b, q.b), lambda z: greatest(z[1], z[2]))) AS any_n FROM bits v JOIN bits q ON v.vec_id < q.vec_id) SELECT a, b, round(both_n / any_n, 6) AS jaccard FROM s WHERE both_n / any_n >= 0.55""")
def alike_bits(spark, d):
    return gr.bridges_by_likeness(rt.bits_of(ad.vectors(spark, d)), 0.55).withColumn("jaccard", F.round("jaccard", 6))


# -- graph ----------------------------------------------------------------------------------


@query("shared_tags", with_sql(", t AS (SELECT * FROM tags) SELECT x.node_id AS a, y.node_id AS b, 'tagged' AS relation, round(least(0.6::double, 0.3::double + 0.1::double * count(*)), 6) AS weight FROM t x JOIN t y ON x.tag = y.tag AND x.node_id < y.node_id GROUP BY ALL", "tags"))
def shared_tags(spark, d):
    return gr.shared_tags(ad.tags(spark, d))


@query("topic_overlap", f"""WITH n AS (SELECT id, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x) >= 4 AND NOT list_contains([{_STOP}], x)), lambda x: CASE WHEN x = 'thre' THEN 'ther' ELSE x END)) AS t FROM (SELECT conv_id * 1000 + turn AS id, text FROM conversations)),
w AS (SELECT id, unnest(t) AS token FROM n), s AS (SELECT id, count(*) AS size FROM w GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM w x JOIN w y ON x.token = y.token AND x.id::varchar < y.id::varchar GROUP BY ALL HAVING count(*) >= 2),
j AS (SELECT a, b, n / (sa.size + sb.size - n) AS weight FROM p JOIN s sa ON sa.id = a JOIN s sb ON sb.id = b), m AS (SELECT median(weight) AS m FROM j), t AS (SELECT any_value(m) - 1.5::double * median(abs(weight - m)) AS tau FROM j, m)
SELECT a::varchar AS a, b::varchar AS b, round(weight, 6) AS weight FROM j, t WHERE weight >= greatest(0.3::double, coalesce(tau, 0.3::double))""")
def topic_overlap(spark, d):
    n = ad.journal(spark, d).select(F.col("id").cast("string").alias("node_id"), F.col("text").alias("content"))
    return gr.topic_overlap(n, {"ther": ["thre"]}).select("a", "b", F.round("weight", 6).alias("weight"))


@query("co_retrieved", with_sql(", x AS (SELECT DISTINCT l_orderkey, 'p' || l_partkey::varchar AS p FROM lineitem), c AS (SELECT a.p AS a, b.p AS b, count(*) AS n FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, round(least(0.6::double, 0.3::double + 0.1::double * n), 6) AS weight FROM c SEMI JOIN nodes x ON c.a = x.node_id SEMI JOIN nodes y ON c.b = y.node_id", "nodes"))
def co_retrieved(spark, d):
    line = ad.table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"))
    rows = line.count()
    x = jn.in_tasks(line, rows, "l_orderkey").distinct()
    pairs = x.select("l_orderkey", F.col("p").alias("a")).join(x.select("l_orderkey", F.col("p").alias("b")), "l_orderkey").where("a < b")
    pairs = jn.in_tasks(pairs.select("a", "b"), rows, "a", "b")
    return gr.co_retrieved(pairs, ad.nodes(spark, d)).select("a", "b", F.round("weight", 6).alias("weight"))


@query("co_cited", with_sql(", x AS (SELECT DISTINCT source_id, target_id FROM edges) SELECT a.target_id AS a, b.target_id AS b, round(least(0.6::double, 0.3::double + 0.05::double * (count(*) - 1)), 6) AS weight FROM x a JOIN x b ON a.source_id = b.source_id AND a.target_id < b.target_id GROUP BY ALL", "edges"))
def co_cited(spark, d):
    return gr.co_cited(ad.edges(spark, d)).select("a", "b", "weight")


@query("belief_gain", with_sql(", c AS (SELECT 's' || s_suppkey::varchar AS node_id, s_acctbal / 10000 AS confidence FROM supplier) SELECT target_id, round(0.1 * max(confidence * weight), 6) AS gain FROM edges JOIN c ON source_id = node_id GROUP BY target_id", "edges"))
def belief_gain(spark, d):
    c = ad.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), (F.col("s_acctbal") / 10000).alias("confidence"))
    return gr.belief_gain(ad.edges(spark, d), c).withColumn("gain", F.round("gain", 6))


@query("edge_validity", with_sql(f" SELECT source_id, target_id, CASE WHEN valid_from <= {THEN} AND (valid_to IS NULL OR valid_to >= {THEN}) THEN 'active' ELSE 'expired' END AS status FROM edges", "edges"))
def edge_validity(spark, d):
    return gr.validity(ad.edges(spark, d), THEN).select("source_id", "target_id", "status")


@query("centrality", with_sql(", e AS (SELECT source_id AS n FROM edges UNION ALL SELECT target_id FROM edges), c AS (SELECT n, count(*) AS k FROM e GROUP BY n) SELECT node_id, coalesce(k, 0)::bigint AS degree FROM nodes LEFT JOIN c ON node_id = n", "nodes", "edges"))
def centrality(spark, d):
    return gr.degrees(ad.nodes(spark, d), ad.edges(spark, d))


@query("isolated_nodes", with_sql(", e AS (SELECT * FROM edges WHERE weight > 0.4) SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT source_id FROM e) AND node_id NOT IN (SELECT target_id FROM e)", "nodes", "edges"))
def isolated_nodes(spark, d):
    return gr.isolated(ad.nodes(spark, d), ad.edges(spark, d).where("weight > 0.4")).select("node_id")


@query("dangling_edges", with_sql(", n AS (SELECT node_id FROM nodes WHERE node_type <> 'economy') SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT node_id FROM n) AND target_id IN (SELECT node_id FROM n)", "nodes", "edges"))
def dangling_edges(spark, d):
    return gr.without_dangling(ad.edges(spark, d), ad.nodes(spark, d).where("node_type <> 'economy'")).select("source_id", "target_id")


@query("neighbours", with_sql(""", e AS (SELECT source_id, target_id FROM edges), l AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e),
one AS (SELECT 's1' AS o, b, 1 AS k FROM l WHERE a = 's1' UNION SELECT 's2', b, 1 FROM l WHERE a = 's2'), two AS (SELECT DISTINCT o, l.b, 2 AS k FROM one JOIN l ON one.b = l.a)
SELECT o AS origin, b AS node, min(k)::int AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE b <> o GROUP BY ALL""", "edges"))
def neighbours(spark, d):
    start = spark.createDataFrame([("s1",), ("s2",)], "node string")
    return gr.neighbours(ad.edges(spark, d), ad.nodes(spark, d), start, 2)


@query("nrem_edges", with_sql(f", a AS (SELECT source_id, target_id, CASE WHEN ({THEN} - created_at) / 86400 <= 1 THEN weight + 0.05::double WHEN ({THEN} - created_at) / 86400 > 30 THEN weight - 0.01::double ELSE weight END AS weight FROM edges) SELECT source_id, target_id, round(weight, 6) AS weight FROM a WHERE weight >= 0.05", "edges"))
def nrem_edges(spark, d):
    return gr.dream_nrem(ad.edges(spark, d), THEN).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


@query("inhibited_edges", with_sql(""", e AS (SELECT * FROM edges), s AS (SELECT source_id, target_id, weight, source_id AS n FROM e UNION ALL SELECT source_id, target_id, weight, target_id FROM e),
l AS (SELECT n, list_sort(list(weight), 'DESC') AS ws FROM s GROUP BY n), i AS (SELECT source_id, target_id, greatest(0, weight - 0.15::double * coalesce(list_sum(list_transform(list_filter(ws, lambda v: v > weight)[1:7], lambda v: v - weight)), 0)) AS w FROM s JOIN l ON s.n = l.n)
SELECT source_id, target_id, round(min(w), 6) AS weight FROM i GROUP BY ALL""", "edges"))
def inhibited_edges(spark, d):
    return gr.inhibited_edges(ad.edges(spark, d)).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


@query("heavier_edges", with_sql(""", o AS (SELECT * FROM edges), n AS (SELECT source_id, target_id, relation, weight + CASE WHEN hash_even THEN 0.1::double ELSE 0 END AS weight, created_at + 5 AS created_at FROM (SELECT *, length(target_id) % 2 = 0 AS hash_even FROM edges))
SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.target_id, n.target_id) AS target_id, round(CASE WHEN n.weight > o.weight THEN n.weight ELSE o.weight END, 6) AS weight, CASE WHEN n.weight > o.weight THEN n.created_at ELSE o.created_at END AS created_at FROM o LEFT JOIN n ON o.source_id = n.source_id AND o.target_id = n.target_id""", "edges"))
def heavier_edges(spark, d):
    e = ad.edges(spark, d)
    new = e.withColumn("weight", F.col("weight") + F.when(F.length("target_id") % 2 == 0, 0.1).otherwise(0.0)).withColumn("created_at", F.col("created_at") + 5)
    return gr.keep_heavier(e, new).select("source_id", "target_id", F.round("weight", 6).alias("weight"), "created_at")


@query("wiki_link_reach", with_sql(", r AS (SELECT from_path, to_path FROM wiki_links), s AS (SELECT to_path, count(*) AS n FROM r GROUP BY to_path) SELECT to_path, n FROM s WHERE n >= 2", "wiki_links"))
def wiki_link_reach(spark, d):
    return ad.wiki_links(spark, d).groupBy("to_path").agg(F.count("*").alias("n")).where("n >= 2")


# -- life cycle -----------------------------------------------------------------------------


@query("decayed_facts", with_sql(f", x AS (SELECT entry_id, importance, CASE WHEN decay_rate = 0 THEN importance ELSE greatest(0.01, importance * exp(-decay_rate * greatest({NOW} - created_at, 0) / 86400)) END AS n FROM facts JOIN kinds USING (memory_kind)) SELECT entry_id, round(n, 4) AS new_importance, abs(n - importance) > 1e-3 AS changed FROM x", "facts", "kinds"))
def decayed_facts(spark, d):
    return lc.decay(ad.facts(spark, d), policy.kinds(spark), NOW).select("entry_id", F.round("new_importance", 4).alias("new_importance"), "changed")


@query("compacted_facts", with_sql(f", x AS (SELECT entry_id, never_archive, row_number() OVER (PARTITION BY user_id ORDER BY never_archive DESC, round(importance * exp(-decay_rate * greatest({THEN} - created_at, 0) / 86400), 9) DESC, entry_id) AS place FROM facts JOIN kinds USING (memory_kind)) SELECT entry_id, place > 100 AND NOT never_archive AS evicted FROM x", "facts", "kinds"))
def compacted_facts(spark, d):
    return lc.compact(ad.facts(spark, d), policy.kinds(spark), THEN, 100).select("entry_id", "evicted")


_SWEEP = f"created_at + (entry_id % 900) * {DAY}"


@query("swept_facts", with_sql(f""", e AS (SELECT *, {_SWEEP} AS expires_at FROM facts JOIN kinds USING (memory_kind)), c AS (SELECT *, NOT never_archive AS can, NOT never_archive AND expires_at < {THEN} AS due FROM e),
n AS (SELECT *, count(*) OVER w AS n, count_if(can) OVER w AS cans, count_if(due) OVER w AS dues, row_number() OVER (PARTITION BY user_id ORDER BY due DESC, expires_at, entry_id) AS place FROM c WINDOW w AS (PARTITION BY user_id))
SELECT entry_id, due AND dues <= 0.8::double * cans AND place <= greatest(n - 50, 0) AS swept FROM n""", "facts", "kinds"))
def swept_facts(spark, d):
    f = ad.facts(spark, d).withColumn("expires_at", F.expr(_SWEEP))
    return lc.sweep_expired(f, policy.kinds(spark), THEN).select("entry_id", "swept")


@query("reinforced_facts", with_sql(" SELECT entry_id, round(CASE WHEN entry_id IN (SELECT log_id FROM audit WHERE action = 'click') THEN least(1, importance + 0.05::double) ELSE importance END, 6) AS importance FROM facts", "facts", "audit"))
def reinforced_facts(spark, d):
    used = ad.audit(spark, d).where("action = 'click'").select(F.col("log_id").alias("entry_id"))
    return lc.reinforced(ad.facts(spark, d), used).select("entry_id", F.round("importance", 6).alias("importance"))


@query("never_recalled", with_sql(f" SELECT entry_id FROM facts WHERE created_at < {THEN} - 90 * {DAY} AND entry_id NOT IN (SELECT log_id FROM audit WHERE action IN ('view', 'click'))", "facts", "audit"))
def never_recalled(spark, d):
    seen = ad.audit(spark, d).where(F.col("action").isin("view", "click")).select(F.col("log_id").alias("entry_id"))
    return lc.never_recalled(ad.facts(spark, d), seen, THEN).select("entry_id")


@query("journal_tiers", with_sql(f", s AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'received' ELSE 'saved' END AS status, ({NOW - 1_704_000_000} - ts) / {DAY} AS days FROM journal) SELECT id, CASE WHEN status = 'received' THEN 'hot' WHEN days > 28 THEN 'cold' WHEN days >= 25 THEN 'warm' ELSE 'hot' END AS tier FROM s", "journal"))
def journal_tiers(spark, d):
    j = ad.journal(spark, d).withColumn("status", F.when(F.col("id") % 5 == 0, "received").otherwise("saved"))
    return lc.tiers(j, NOW - 1_704_000_000, 25, 28).select("id", "tier")


@query("deduplicated_episodes", with_sql(" SELECT min(episode_id) AS episode_id FROM episodes GROUP BY user_id, summary", "episodes"))
def deduplicated_episodes(spark, d):
    return lc.dedup_episodes(ad.episodes(spark, d)).select("episode_id")


@query("restore_plan", with_sql(f""", c AS (SELECT user_id, key, value FROM facts QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, entry_id DESC) = 1), s AS (SELECT user_id, key, value FROM facts WHERE created_at <= {THEN} QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, entry_id DESC) = 1)
SELECT user_id, key, 'write' AS what FROM s ANTI JOIN c USING (user_id, key, value) UNION ALL SELECT user_id, key, 'delete' FROM c ANTI JOIN s USING (user_id, key)""", "facts"))
def restore_plan(spark, d):
    order = (F.desc("created_at"), F.desc("entry_id"))
    f = ad.facts(spark, d).select("user_id", "key", "value", "created_at", "entry_id")
    plan = lc.restore(wn.latest(f, lc.SCOPE, *order), wn.latest(f.where(F.col("created_at") <= THEN), lc.SCOPE, *order))
    return plan["write"].select("user_id", "key", F.lit("write").alias("what")).unionByName(plan["delete"].withColumn("what", F.lit("delete")))


@query("reranked_recall")
def reranked_recall(spark, d):
    """BM25 candidates re-ranked greedily (see retrieval.rerank); checked against a plain loop in the tests."""
    best = rt.top(_bm25(spark, d), ["query_id"], "doc_id", 100)
    docs = ad.table(spark, d, "documents").select("doc_id", "text")
    pool = best.join(docs, "doc_id").join(F.broadcast(asked(spark)), "query_id").select("query_id", "query", F.col("doc_id").alias("id"), F.col("text").alias("content"), "score")
    return rt.rerank(pool)


@query("packed_context", with_sql(""" , k AS (SELECT id, user_id, ts, text, substr(regexp_replace(lower(text), '\\s+', ' ', 'g'), 1, 80) AS p FROM journal), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id, p ORDER BY ts DESC, id DESC) = 1),
s AS (SELECT id, user_id, sum(length(text) // 4) OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM u) SELECT id, user_id, used::bigint AS used_tokens FROM s WHERE used <= 2000""", "journal"))
def packed_context(spark, d):
    return rt.pack_budget(ad.journal(spark, d), ["user_id"], [F.desc("ts"), F.desc("id")], 2000).select("id", "user_id", "used_tokens")
