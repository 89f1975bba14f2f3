"""Named queries of what messages ask and which sources they are worth, of standing queries and lists of nodes, each with the DuckDB SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import asking as ak
from ..lineage import shared_folder
from ..operators import standing as sd
from ..sources import adapters as ad
from ..sources.adapters import with_sql
from .queries import query

#: What messages end with, by id, so that features occur; half of the messages are nothing else.
TAILS = ["how does this Work in 2024?", "compare git push vs Git pull by friday", "list all", "привет, что такое Память", "what about 12.05 and \"docs\" never", "see http://x.y a blue gear", "помнишь, как мы сделали это вчера?", "show it", "", "did we also remember when he left the house on that long day in may"]
SYN = {"gear": ["cog"], "blue": ["azure"]}
_Q = f"q AS (SELECT id, trim(CASE WHEN id % 20 < 10 THEN t ELSE text || ' ' || t END, ' \n') AS q FROM (SELECT id, text, ({TAILS!r})[id % 10 + 1] AS t FROM journal))"
_any = lambda t, marks: "(" + " OR ".join(f"contains({t}, '{m}')" for m in marks) + ")"
_opens = lambda marks: "(" + " OR ".join(f"starts_with(l, '{m}')" for m in marks) + ")"
_F = f"""w AS (SELECT id, q, lower(q) AS l, regexp_extract_all(lower(q), '{ak.WORD}') AS ws FROM q), v AS (SELECT *, list_distinct(list_filter(ws, lambda x: length(x) >= 3)) AS s, len(ws) AS c FROM w), f AS (SELECT id,
len(list_filter(string_split_regex(q, '\\s+'), lambda x: x <> ''))::int AS length, length(q)::int AS chars, length <= 4 AS is_short, length >= 12 AS is_long, ends_with(l, '?') OR list_has_any(s, {ak.ASKING!r}) AS is_question, contains(q, '?') AS has_question_mark, coalesce(list_contains({ak.ORDERS!r}, ws[1]), false) AS is_imperative, list_has_any(s, {ak.NEGATIONS!r}) AS is_negated,
list_has_any(s, ['gear', 'cog', 'blue', 'azure']) AS has_entity, len(list_filter(regexp_extract_all(q, '{ak.ANY_CASE_WORD}')[2:], lambda x: regexp_matches(x, '^[A-ZА-ЯЁ]')))::int AS n_capitalized, regexp_matches(q, '[0-9]') AS has_numbers, {_any('q', ak.CODE_MARKS)} AS has_code, regexp_matches(q, '{ak.DATE}') AS has_date, regexp_matches(q, '(^|[^\\pL\\pN_])(19|20)[0-9][0-9]($|[^\\pL\\pN_])') AS has_year, {_any('l', ak.TIMES)} AS has_relative_time, {_any('l', ak.DEADLINES)} AS has_deadline,
CASE WHEN c = 0 THEN 0 ELSE len(s) / c END AS unique_ratio, CASE WHEN c = 0 THEN 0 ELSE len(list_filter(ws, lambda x: list_contains({ak.LIGHT_WORDS!r}, x))) / c END AS stopword_ratio, CASE WHEN c = 0 THEN 0 ELSE length(array_to_string(ws, '')) / c END AS avg_word_len,
regexp_matches(l, '(^|[^\\pL\\pN_])(все(х|м|е|ё)?|список|enumerate)($|[^\\pL\\pN_])|перечисл|list\\s+all') AS is_enumerative, {_any('l', ak.COMPARISONS)} AS is_comparison, {_opens(ak.GOING_ON)} OR list_has_any(s, {ak.GOING_ON_WORDS!r}) OR contains(l, 'what about') AS is_followup, {_opens(ak.GREETINGS)} AS is_greeting, {_any('l', ['http', 'www.'])} AS has_url, {_any('q', ['"', '«'])} AS has_quote, {_any('l', ak.WIKI_MARKS)} AS wants_wiki, {_any('l', ak.EPISODE_MARKS)} AS wants_episodic FROM v)"""
_RATIOS = ("unique_ratio", "stopword_ratio", "avg_word_len")


def _features(spark, d):
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("id") % 10 + 1).cast("int"))
    q = F.when(F.col("id") % 20 < 10, tail).otherwise(F.concat_ws(" ", "text", tail))
    return ad.journal(spark, d).select("id", ak.query_features(q, SYN).alias("f"))


@query("query_features", with_sql(f", {_Q}, {_F} SELECT * EXCLUDE ({', '.join(_RATIOS)}), round(unique_ratio, 1) AS unique_ratio, round(stopword_ratio, 1) AS stopword_ratio, round(avg_word_len, 0) AS avg_word_len FROM f", "journal"))
def query_features(spark, d):
    """Ratios are compared to one digit."""
    got = _features(spark, d).select("id", "f.*")
    return got.withColumns({"unique_ratio": F.round("unique_ratio", 1), "stopword_ratio": F.round("stopword_ratio", 1), "avg_word_len": F.round("avg_word_len", 0)})


@query("gated_sources", with_sql(f""", {_Q}, {_F}, r AS (SELECT id, CASE WHEN is_enumerative THEN 'wcg' WHEN is_short AND NOT is_question THEN 'rc' WHEN has_entity THEN 'rwcg' WHEN has_code OR has_url THEN 'rwc' WHEN wants_episodic OR has_relative_time AND is_question THEN 'rec' ELSE 'rwecg' END AS g FROM f)
SELECT id, contains(g, 'r') AS rag, contains(g, 'w') AS wiki, contains(g, 'e') AS episodic, contains(g, 'c') AS core, contains(g, 'g') AS graph FROM r""", "journal"))
def gated_sources(spark, d):
    return _features(spark, d).select("id", ak.gate_sources(F.col("f")).alias("g")).select("id", "g.*")


# -- standing queries and lists of nodes --------------------------------------------------


@query("standing_query", with_sql(" SELECT entry_id, round(importance, 6) AS importance FROM facts WHERE importance >= 0.5 AND contains(lower(value), 'urgent') AND user_id = 'u3' ORDER BY created_at DESC, entry_id DESC LIMIT 100", "facts"))
def standing_query(spark, d):
    folder = f"{shared_folder(spark).rstrip('/')}/standing-{uuid.uuid4().hex}"
    for least in (0.9, 0.5):
        sd.save(spark, folder, "urgent-facts", {"description": "what is urgent", "importance_min": least, "content_like": "Urgent", "limit": 100})
    return sd.run(spark, folder, "urgent-facts", {"core": ad.facts(spark, d)}, "u3").select("entry_id", F.round("importance", 6).alias("importance"))


_OWNED = "o AS (SELECT *, 'u' || (substr(node_id, 2)::bigint % 3)::varchar AS user_id, length(content) / 60 AS confidence FROM nodes)"


def _owned(spark, d):
    user = F.concat(F.lit("u"), (F.substring("node_id", 2, 20).cast("long") % 3).cast("string"))
    return ad.nodes(spark, d).withColumn("user_id", user).withColumn("confidence", F.length("content") / 60)


@query("nodes_of_type", with_sql(f", {_OWNED} SELECT node_id, round(confidence, 6) AS confidence FROM o WHERE user_id = 'u1' AND node_type = 'supplier' ORDER BY o.confidence DESC, node_id LIMIT 20", "nodes"))
def nodes_of_type(spark, d):
    return sd.nodes_of_type(_owned(spark, d), "u1", "supplier").select("node_id", F.round("confidence", 6).alias("confidence"))


@query("nodes_tagged", with_sql(f", {_OWNED} SELECT node_id, round(confidence, 6) AS confidence FROM o WHERE user_id = 'u1' AND node_id IN (SELECT node_id FROM tags WHERE tag = 'size:7') ORDER BY o.confidence DESC, node_id LIMIT 20", "nodes", "tags"))
def nodes_tagged(spark, d):
    return sd.nodes_tagged(_owned(spark, d), ad.tags(spark, d), "u1", "size:7").select("node_id", F.round("confidence", 6).alias("confidence"))
