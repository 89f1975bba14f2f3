"""Named queries of rules, hints and feelings found in texts and of the stored index, each with the DuckDB SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..lineage import shared_folder
from ..operators import index as ix
from ..operators import matching as mt
from ..sources import adapters as ad
from ..sources.adapters import with_sql
from .queries import _ASKED, _BM25, asked, query

#: What messages say besides their own words, by id, so that words of feelings and routes occur.
SAID = ["I really love you", "my Dear friend", "i am very sad!! why??? no", "спасибо тебе большое", "thanks 🙏🙌", "WOW! Great", "nothing", "what did we say earlier? recap", "how to remember this skill for now", "я счастлив и мне очень грустно", "so angry 😡 and worried", "", "было полезно, feedback", "dearest sadness", "i love miss you"]
_SAID_SQL = f"said AS (SELECT id, user_id, text || ' ' || ({SAID!r})[id % {len(SAID)} + 1] AS text FROM journal)"


def said(spark, d):
    """Messages with a remark of their own: id, user_id, text."""
    return ad.journal(spark, d).select("id", "user_id", F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, SAID)), (F.col("id") % len(SAID) + 1).cast("int"))).alias("text"))


@query("disclosures", with_sql(""", r AS (SELECT item_id AS rule_id, 'u' || (item_id % 7)::varchar AS user_id, 'rule ' || item_id::varchar AS name, list_slice(string_split(lower(text), ' '), 3, 5) AS kw FROM benchmark WHERE item_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY item_id % 7 ORDER BY item_id DESC) <= 4)
SELECT id, rule_id, name, place::int AS place FROM (SELECT id, rule_id, name, row_number() OVER (PARTITION BY id ORDER BY rule_id DESC) AS place FROM journal j JOIN r ON j.user_id = r.user_id AND len(list_filter(kw, lambda k: contains(lower(j.text), k))) > 0) WHERE place <= 3""", "journal"))
def disclosures(spark, d):
    b = ad.table(spark, d, "benchmark")
    rules = b.select(F.col("item_id").alias("rule_id"), F.concat(F.lit("u"), (F.col("item_id") % 7).cast("string")).alias("user_id"), F.concat(F.lit("rule "), F.col("item_id").cast("string")).alias("name"), F.slice(F.split("text", " "), 3, 3).alias("keywords"), (F.col("item_id") % 5 != 0).alias("enabled"))
    return mt.disclosures(ad.journal(spark, d).select("id", "user_id", "text"), rules, "id", newest=4).select("id", "rule_id", "name", "place")


_ROUTES_SQL = "routes AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}', {ws.split('|')!r})" for i, (name, ws) in enumerate(mt.ROUTES)) + ") t(k, route, words))"


@query("steering_hints", with_sql(f", {_SAID_SQL}, {_ROUTES_SQL} SELECT id, route, place::int AS place FROM (SELECT id, route, row_number() OVER (PARTITION BY id ORDER BY k) AS place FROM said JOIN routes ON len(list_filter(words, lambda w: contains(lower(text), w))) > 0) WHERE place <= 3", "journal"))
def steering_hints(spark, d):
    return mt.steering_hints(said(spark, d), "id", "text")


_END = "([^\\pL\\pN_]|$)"
_PHRASES_SQL = " UNION ALL ".join("SELECT id, '{}' AS feeling, {}::double AS score, 'phrase' AS source FROM low WHERE regexp_matches(text, '{}')".format(e, s, "\\s+([\\pL\\pN_]+\\s+)?".join(p.split(" "))) for p, e, s in mt.FEELING_PHRASES)
_WORDS_SQL = " UNION ALL ".join(f"SELECT id, '{e}', 0.4::double, 'word' FROM low WHERE regexp_matches(text, '(^|[^\\pL\\pN_])({'|'.join(w for w in ws if w != 'wow!')}){_END}')" for e, ws in mt.FEELING_WORDS.items())
_SIGNS_SQL = " UNION ALL ".join(f"SELECT id, '{e}', 0.3::double, 'sign' FROM low WHERE len(list_filter({ws!r}, lambda w: contains(text, w))) > 0" for e, ws in mt.FEELING_SIGNS.items())


@query("emotions", with_sql(f", {_SAID_SQL}, low AS (SELECT id, lower(text) AS text FROM said), f AS ({_PHRASES_SQL} UNION ALL {_WORDS_SQL} UNION ALL {_SIGNS_SQL}) SELECT id, feeling, max(score) AS score, arg_max(source, score) AS source FROM f GROUP BY id, feeling", "journal"))
def emotions(spark, d):
    return said(spark, d).select("id", F.inline(mt.feelings(F.col("text"))))


@query("save_triggers", with_sql(f""", {_SAID_SQL}, low AS (SELECT id, lower(text) AS text FROM said), f AS ({_PHRASES_SQL} UNION ALL {_WORDS_SQL} UNION ALL {_SIGNS_SQL}), g AS (SELECT id, 'emotion_' || feeling AS trigger, max(score) AS score, feeling AS k FROM f GROUP BY id, feeling),
h AS (SELECT id, trigger, score, k FROM g UNION ALL SELECT id, 'long_message', 0.3::double, '~1' FROM said WHERE length(text) > 300 UNION ALL SELECT id, 'complex_question', 0.4::double, '~2' FROM said WHERE length(text) - length(replace(text, '?', '')) >= 3),
l AS (SELECT DISTINCT h.id, 'exclamation' AS trigger, 0.3::double AS score, '~3' AS k FROM h JOIN said ON h.id = said.id WHERE length(text) - length(replace(text, '!', '')) >= 2)
SELECT id, trigger, score FROM (SELECT * FROM h UNION ALL SELECT * FROM l) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, k) = 1""", "journal"))
def save_triggers(spark, d):
    return said(spark, d).select("id", mt.save_trigger(F.col("text")).alias("t")).where("t is not null").select("id", "t.trigger", "t.score")


# -- the stored index ---------------------------------------------------------------------

_built: dict[tuple[str, str], str] = {}


def store_of(spark, d):
    """Documents as a store of two batches, built once by each application below the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        folder = ix.create(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
        docs = ad.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("user_id"), F.lit("").alias("title"), F.col("text").alias("content"))
        for part in (0, 1):
            ix.ingest(docs.where(F.col("page_id") % 2 == part), folder)
        _built[key] = folder
    return _built[key]


# Of copies in both batches the one with an even number came first.
_STORED = "once AS (SELECT arg_min(doc_id, (doc_id % 2, doc_id)) AS doc_id, text, lang FROM documents WHERE regexp_matches(text, '[^\\s]') GROUP BY lang, text)"


@query("indexed_search", f"WITH {_ASKED}, {_STORED}, {_BM25.replace('FROM documents', 'FROM once')} SELECT query_id, doc_id AS page_id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 50")
def indexed_search(spark, d):
    return ix.search(spark, store_of(spark, d), asked(spark), "fts", 50).select("query_id", "page_id", "score")


@query("ingested_pages", f"WITH {_STORED} SELECT doc_id AS page_id, sha256(text) AS hash, len(regexp_extract_all(lower(text), '[\\pL\\pN]+'))::int AS dl FROM once")
def ingested_pages(spark, d):
    return ix.pages(spark, store_of(spark, d)).select("page_id", "hash", "dl")


@query("hybrid_search")
def hybrid_search(spark, d):
    """By words and bits, fused by rank; checked against plain Python in the tests."""
    return ix.search(spark, store_of(spark, d), asked(spark), "auto", 10)
