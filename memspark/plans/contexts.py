"""Named queries of context packing, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context as cx
from ..sources import adapters as ad
from ..sources.adapters import with_sql
from .queries import query

KEYS = ["user_id"]
BUDGET = 600


def _placed(df, *order):
    return df.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def _sources(spark, d):
    """Blocks by user: place, score, content. Messages that hold a word are relevant, those of agents the day's, those of the service open matters."""
    j, newest = ad.journal(spark, d), (F.desc("ts"), F.desc("id"))
    block = lambda df, score, content: df.select("user_id", "place", F.lit(score).alias("score"), content.alias("content"))
    f = _placed(ad.facts(spark, d).where("importance >= 0.8"), F.desc("importance"), "entry_id")
    return {
        "important": f.select("user_id", "place", F.col("importance").alias("score"), F.concat("key", F.lit("="), F.substring("value", 1, 80)).alias("content")),
        "relevant": block(_placed(j.where(F.contains(F.lower("text"), F.lit("that"))), *newest), 0.6, F.col("text")),
        "recent": block(_placed(j, *newest).where("place <= 10"), 0.5, F.concat("layer", F.lit(": "), F.substring("text", 1, 80))),
        "day": block(_placed(j.where("layer = 'agent'"), *newest).where("place <= 5"), 0.4, F.col("text")),
        "ops": block(_placed(j.where("raw_type = 'service'"), *newest).where("place <= 5"), 0.6, F.col("text")),
    }


def _users(spark, d):
    """Users with what they ask; a third of them ask nothing."""
    return ad.journal(spark, d).select("user_id").distinct().withColumn("query", F.when(F.substring("user_id", 2, 1).cast("int") % 3 == 0, " ").otherwise("that"))


_PLACE = "row_number() OVER (PARTITION BY user_id ORDER BY {})"
_NEW = _PLACE.format("ts DESC, id DESC")
_SOURCES = f"""imp AS (SELECT user_id, {_PLACE.format('importance DESC, entry_id')} AS k, importance AS score, key || '=' || left(value, 80) AS content FROM facts WHERE importance >= 0.8),
rel AS (SELECT user_id, {_NEW} AS k, 0.6::double AS score, text AS content FROM journal WHERE contains(lower(text), 'that')),
rec AS (SELECT user_id, {_NEW} AS k, 0.5::double AS score, layer || ': ' || left(text, 80) AS content FROM journal QUALIFY {_NEW} <= 10),
dy AS (SELECT user_id, {_NEW} AS k, 0.4::double AS score, text AS content FROM journal WHERE layer = 'agent' QUALIFY {_NEW} <= 5),
op AS (SELECT user_id, {_NEW} AS k, 0.6::double AS score, text AS content FROM journal WHERE raw_type = 'service' QUALIFY {_NEW} <= 5)"""
_COST = "(length(regexp_replace(content, '[^\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7af}]', '', 'g')) + (length(content) - length(regexp_replace(content, '[^\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7af}]', '', 'g'))) // 4)::bigint"
_KEY = "left(trim(regexp_replace({}, '\\s+', ' ', 'g')), 80)"
_ROWS = f"rows AS (SELECT user_id, s, k, source, score, trim(content) AS content, also FROM cand WHERE trim(content) <> ''), costed AS (SELECT *, {_COST} AS cost, {_KEY.format('content')} AS key FROM rows)"
#: Walks the blocks of each user in order under one budget.
_WALK = f"""{_ROWS}, steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, k) AS n FROM costed),
walk(user_id, n, room, seen, taken) AS (SELECT DISTINCT user_id, 0::bigint, {BUDGET}::bigint, []::varchar[], false FROM steps
UNION ALL SELECT user_id, n, CASE WHEN ok THEN room - cost ELSE room END, CASE WHEN ok THEN list_concat(list_append(seen, key), also) ELSE seen END, ok FROM (SELECT w.user_id, s.n, w.room, w.seen, s.cost, s.key, s.also, NOT list_contains(w.seen, s.key) AND s.cost <= w.room AS ok FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.n = w.n + 1))
SELECT s.user_id, s.source, s.content, s.cost AS tokens, (row_number() OVER (PARTITION BY s.user_id ORDER BY s.n))::int AS place FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.n = w.n WHERE taken"""


def _cand(*parts: str) -> str:
    """cand: the blocks of all sources; a part is a name, the subquery and what else its blocks stand for."""
    rows = [f"SELECT user_id, {i} AS s, k, '{name}' AS source, score, content, {also} AS also FROM {table}" for i, (name, table, also) in enumerate(parts)]
    return f"cand AS ({' UNION ALL '.join(rows)})"


_NONE = "[]::varchar[]"
_FLOORS = [int(BUDGET * w) for w in cx.WEIGHTS.values()]
_BY_WEIGHTS = f"""{_ROWS}, steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pass, s, k) AS n FROM costed, (SELECT unnest([1, 2]) AS pass)),
walk(user_id, n, used, seen, taken) AS (SELECT DISTINCT user_id, 0::bigint, [0, 0, 0, 0, 0]::bigint[], []::varchar[], false FROM steps
UNION ALL SELECT user_id, n, list_transform(range(1, 6), lambda i: used[i] + CASE WHEN ok AND i = s + 1 THEN cost ELSE 0 END), CASE WHEN ok THEN list_append(seen, key) ELSE seen END, ok FROM (SELECT *, NOT list_contains(seen, key) AND used[s + 1] < cap AND used[s + 1] + cost <= cap AS ok FROM
  (SELECT w.user_id, s.n, s.s, w.used, w.seen, s.cost, s.key, CASE WHEN pass = 1 THEN ({_FLOORS})[s.s + 1] ELSE least(w.used[s.s + 1] + {BUDGET} - list_sum(w.used), greatest(2 * ({_FLOORS})[s.s + 1], 40)) END AS cap FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.n = w.n + 1)))
SELECT s.user_id, s.source, s.content, s.cost AS tokens, (row_number() OVER (PARTITION BY s.user_id ORDER BY s.n))::int AS place FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.n = w.n WHERE taken"""
_ALL = [("important", f"imp WHERE k <= {cx.MOST}", _NONE), ("relevant", f"rel WHERE k <= {cx.MOST}", _NONE), ("recent", "rec", _NONE), ("day", "dy", _NONE), ("ops", "op", _NONE)]
_OUT = ["user_id", "source", "content", "tokens", "place"]


@query("smart_context", with_sql(f", {_SOURCES}, {_cand(*_ALL)}, {_BY_WEIGHTS}", "facts", "journal", recursive=True))
def smart_context(spark, d):
    return cx.pack_by_weights(_sources(spark, d), KEYS, BUDGET).select(_OUT)


_MARKS = "pre AS (SELECT user_id, 1 AS k, 1.0::double AS score, string_agg(content, ' | ' ORDER BY k) AS content, list({key} ORDER BY k) AS also FROM op WHERE k <= 3 GROUP BY user_id)".replace("{key}", _KEY.format("content"))
_ASKS = "asks AS (SELECT DISTINCT user_id FROM journal WHERE substr(user_id, 2, 1)::int % 3 <> 0), us AS (SELECT DISTINCT user_id FROM journal)"


@query("recall_protocol", with_sql(f", {_SOURCES}, {_MARKS}, {_ASKS}, " + _cand(("markers", "pre", "also"), ("session", "rec SEMI JOIN asks USING (user_id)", _NONE), ("semantic", f"rel SEMI JOIN asks USING (user_id) WHERE k <= {cx.MOST}", _NONE), ("day", "dy SEMI JOIN us USING (user_id)", _NONE)) + f", {_WALK}", "facts", "journal", recursive=True))
def recall_protocol(spark, d):
    s = _sources(spark, d)
    marks = cx.joined(s["ops"], KEYS, [F.col("place")], F.col("content"), 3, " | ", 1.0)
    axes = {"markers": marks, "session": s["recent"], "semantic": s["relevant"], "day": s["day"]}
    return cx.recall_protocol(axes, _users(spark, d), KEYS, BUDGET).select(_OUT)


_PIN = "pin AS (SELECT user_id, 1 AS k, 1.0::double AS score, left(string_agg('📌 ' || key || '=' || left(value, 80), '; ' ORDER BY key, entry_id), 400) AS content FROM (SELECT * FROM facts WHERE entry_id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY key, entry_id) <= 10) GROUP BY user_id)"


@query("inject_blocks", with_sql(f", {_SOURCES}, {_PIN}, hit AS (SELECT user_id, k, score, left(content, 400) AS content FROM rel WHERE k <= 10), " + _cand(("pinned", "pin", _NONE), ("relevant", "hit", _NONE), ("facts", "imp WHERE k <= 10", _NONE)) + f", {_WALK}", "facts", "journal", recursive=True))
def inject_blocks(spark, d):
    s = _sources(spark, d)
    # Keys repeat, so the entry decides among them.
    pinned = ad.facts(spark, d).where("entry_id % 10 = 0").select("user_id", F.struct("key", "entry_id").alias("_o"), "key", "value")
    first = _placed(pinned, "_o").where("place <= 10").select("user_id", "key", "value", "place")
    return cx.inject_blocks(first, s["relevant"], s["important"], KEYS, BUDGET, order=[F.col("place")]).select(_OUT)


_RECAP = """ses AS (SELECT user_id, max(ts) AS last_ts, conv_id, arg_min(text, ts) AS summary FROM (SELECT *, id // 1000 AS conv_id FROM journal WHERE raw_type <> 'service') GROUP BY user_id, conv_id),
las AS (SELECT user_id, 1 AS k, 0.9::double AS score, 'last session: ' || left(arg_max(summary, last_ts), 160) AS content FROM ses GROUP BY user_id),
chk AS (SELECT user_id, 1 AS k, 0.95::double AS score, 'checkpoint: ' || left(arg_max(text, ts), 220) AS content FROM journal WHERE layer = 'agent' GROUP BY user_id),
pen AS (SELECT user_id, 1 AS k, 0.8::double AS score, string_agg('pad:' || left(content, 60), ' | ' ORDER BY k) AS content FROM op GROUP BY user_id)"""


@query("session_recap", with_sql(f", {_SOURCES}, {_RECAP}, " + _cand(("recap_session", "las", _NONE), ("recap_checkpoint", "chk", _NONE), ("recap_pending", "pen", _NONE), ("day", "dy", _NONE)) + f", {_WALK}", "facts", "journal", recursive=True))
def session_recap(spark, d):
    j, s = ad.journal(spark, d), _sources(spark, d)
    talk = j.where("raw_type <> 'service'").groupBy("user_id", F.floor(F.col("id") / 1000).alias("conv_id"))
    sessions = talk.agg(F.max("ts").alias("at"), F.min_by("text", "ts").alias("summary"), F.count("*").alias("n_messages"))
    checkpoints = j.where("layer = 'agent'").select("user_id", F.col("text").alias("content"), F.col("ts").alias("at"))
    pending = s["ops"].select("user_id", "content", (-F.col("place")).alias("at"))
    return cx.session_recap(sessions, checkpoints, pending, s["day"], KEYS, BUDGET).select(_OUT)
