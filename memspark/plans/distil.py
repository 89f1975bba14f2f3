"""Named queries from messages to facts, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as tx
from ..operators import distil as ds
from ..operators import windows as wn
from ..sources import adapters as ad
from ..sources.adapters import with_sql
from .queries import query

#: What is put before the given texts by id, so that every class of message occurs.
OPENINGS = ["", "We decided. ", "How to: ", "Do not touch. ", "What is it? ", "todo ", "DREAM: fact: ", '{"type": "tool_use", "x": "', "Thanks ", "Shipped abcdef12 ", "I prefer it. ", "probably ", "61 msgs; started with: ",
            "Please provide a final response summarizing ", "---\nname: x ", "list all fix! config ", "Error? важно ", "the user wants ", "I commit to it ", "good morning "]
SYNONYMS = {"postgres": ["postgresql", "psql"], "hand": ["thand", "wand"], "alice": ["алиса"]}
_Q = lambda x: x.replace("'", "''")
_LIST = lambda xs: "[" + ", ".join(f"'{_Q(x)}'" for x in xs) + "]"
_M = f"""msgs AS (SELECT id, ts, layer, user_id, raw_type, {_LIST(OPENINGS)}[id % {len(OPENINGS)} + 1] || CASE WHEN id % 3 = 0 THEN array_to_string(string_split(text, ' ')[1:4], ' ') ELSE text END AS text FROM journal)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    j = ad.journal(spark, d)
    short = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    opening = F.get(F.array(*map(F.lit, OPENINGS)), (F.col("id") % len(OPENINGS)).cast("int"))
    return j.withColumn("text", F.concat(opening, F.when(F.col("id") % 3 == 0, short).otherwise(F.col("text"))))


def sql(body: str) -> str:
    return with_sql(f", {_M}{body}", "journal")


_alt = lambda xs: "|".join(map(ds._plain, xs))
_TRANSCRIPT = f"(contains(substr(text, 1, 80), chr(10)) OR regexp_matches(text, '{ds.TRANSCRIPT_HEAD}'))"
_DUMP = f"(regexp_matches(text, '{ds.DUMP_HEAD}') OR contains(substr(text, 1, 200), 'tool_use_id'))"
_INJECTED = f"(regexp_matches(text, '{ds.SKILL_HEAD}') OR regexp_matches(substr(text, 1, 400), '{ds.CRON}'))"
_JUNK = f"CASE WHEN regexp_matches(substr(text, 1, 200), '{ds.ARC_ECHO}') THEN 'arc_echo' WHEN {_INJECTED} THEN 'system_injection' WHEN regexp_matches(substr(text, 1, 200), '{_Q(ds.HARNESS_LIMIT)}') THEN 'harness_limit' END"


def _dialogic(c: str, most: int = 8) -> str:
    words = f"list_distinct(regexp_extract_all(lower({c}), '[а-яёa-z]+'))"
    return f"""(suffix(regexp_replace(rtrim(lower({c}), ' '), '[!.…;:»"'']+$', ''), '?') OR (len({words}) <= {most} AND (list_has_any({words}, {_LIST(ds.DIALOGIC_WORDS)}) OR regexp_matches(lower({c}), '{_alt(ds.DIALOGIC_PHRASES)}'))))"""


def _status(c: str) -> str:
    held = " OR ".join(f"regexp_matches({c}, '{p}')" for p in ds.STATUS_COMPANIONS)
    return f"((regexp_matches({c}, '(?i)(^|[^\\pL\\pN_])({'|'.join(ds.STATUS_WORDS)})($|[^\\pL\\pN_])') OR regexp_matches(upper(substr({c}, 1, 40)), '{_alt(ds.STATUS_HEADS)}')) AND ({held}))"


@query("message_shapes", sql(f" SELECT id, {_TRANSCRIPT} AS transcript, {_DUMP} AS dump, {_JUNK} AS junk, {_dialogic('text')} AS dialogic, {_status('text')} AS status FROM msgs"))
def message_shapes(spark, d):
    t = F.col("text")
    return messages(spark, d).select("id", ds.looks_like_transcript(t).alias("transcript"), ds.looks_like_dump(t).alias("dump"), ds.junk_class(t).alias("junk"), ds.is_dialogic(t).alias("dialogic"), ds.is_status_report(t).alias("status"))


@query("dream_markers", sql(f" SELECT id, lower(regexp_extract(text, '{ds.DREAM}', 1)) AS target, substr(trim(regexp_extract(text, '{ds.DREAM}', 2)), 1, 500) AS content FROM msgs WHERE regexp_matches(text, '{ds.DREAM}')"))
def dream_markers(spark, d):
    return messages(spark, d).select("id", ds.dream_marker(F.col("text")).alias("m")).where("m is not null").select("id", "m.*")


def _hit(c: str, word: str) -> str:
    bare = word.replace(" ", "")
    return f"regexp_matches({c}, '(?i)(^|[^A-Za-z0-9-]){ds._plain(word)}')" if bare.isascii() and bare.isalpha() else f"contains(lower({c}), '{word}')"


def _opens(c: str, words: list[str]) -> str:
    first = "lower(regexp_replace(regexp_extract(s, '^[\\s*_«»\"''“”„—–-]*(\\S+)', 1), '[,.:;!?—–]+$', ''))"
    return f"list_has_any(list_transform(string_split_regex(regexp_replace(trim({c}), '([.!?…])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: {first}), {_LIST(words)})"


def _kind(c: str) -> str:
    out = "CASE"
    for kind, words in ds.KIND_WORDS:
        parts = [_hit(c, w) for w in words] + ([f"contains({c}, '?')", _opens(c, ds.QUESTION_WORDS)] if kind == "question" else []) + ([_opens(c, ds.TASK_OPENERS)] if kind == "todo" else []) + ([_opens(c, ds.RULE_OPENERS)] if kind == "rule" else [])
        out += f" WHEN {' OR '.join(parts)} THEN '{kind}'"
    return out + " ELSE 'fact' END"


_TOPIC = lambda c: "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{_alt(m)}') THEN '{t}'" for t, m in ds.TOPICS) + " ELSE 'general' END"


@query("message_kinds", sql(f""" SELECT id, {_kind('text')} AS kind, {_TOPIC('text')} AS topic, CASE WHEN len(regexp_extract_all(text, '{_Q(ds.AGENT_SIGNALS)}')) > len(regexp_extract_all(text, '{_Q(ds.USER_SIGNALS)}')) THEN 'agent' ELSE 'user' END AS route,
CASE WHEN starts_with(text, '{{"') THEN 'plain' ELSE 'user-message' END AS raw FROM msgs"""))
def message_kinds(spark, d):
    t = F.col("text")
    return messages(spark, d).select("id", ds.kind_of(t).alias("kind"), ds.topic_of(t).alias("topic"), ds.layer_of(t).alias("route"), ds.raw_class(t).alias("raw"))


_STRUCTURE = f"""CASE WHEN length(text) < 20 THEN 0.0::double ELSE least(1, CASE WHEN length(text) > 100 THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '?') THEN 0.15 ELSE 0 END + CASE WHEN contains(text, '!') THEN 0.1 ELSE 0 END
+ CASE WHEN regexp_matches(lower(text), '{"|".join(tx.KEYWORDS)}') THEN 0.2 ELSE 0 END + CASE WHEN len(string_split(text, chr(10))) >= 3 THEN 0.15 ELSE 0 END + CASE WHEN contains(text, '?') AND regexp_matches(lower(text), '{"|".join(tx.KEYWORDS)}') THEN 0.1 ELSE 0 END)::double END"""
_IMPORTANCE = f"CASE WHEN ({_dialogic('text', 10)} AND length(text) < 120) OR {_status('text')} THEN least({_STRUCTURE}, 0.35::double) ELSE {_STRUCTURE} END"
_EASY = "', '".join(sorted({k for k, _, _, never, *_ in policy.KINDS if never} | {"instruction", "rule", "commitment"}))
_GATE = lambda kind, score: f"NOT {_TRANSCRIPT} AND NOT {_dialogic('text')} AND NOT {_status('text')} AND {score} >= CASE WHEN {kind} IN ('{_EASY}') THEN 0.3 WHEN {kind} = 'preference' THEN 0.5 ELSE 0.7 END"


@query("promotion_gate", sql(f", k AS (SELECT id, text, {_kind('text')} AS kind, id % 10 / 10 AS score, {_IMPORTANCE} AS importance FROM msgs) SELECT id, kind, round(importance, 6) AS importance, {_GATE('kind', 'score')} AS passes, CASE WHEN id % 10 >= 8 THEN 'intimate' WHEN id % 7 >= 4 THEN 'tech' WHEN {_dialogic('text')} THEN 'everyday' ELSE 'mixed' END AS domain FROM k"))
def promotion_gate(spark, d):
    m = messages(spark, d).withColumn("kind", ds.kind_of(F.col("text"))).withColumn("score", F.col("id") % 10 / 10)
    t = F.col("text")
    domain = ds.domain_of(F.when(F.col("id") % 10 >= 8, 0.6).otherwise(0.1), (F.col("id") % 7) / 10, t)
    return m.select("id", "kind", F.round(ds.importance(t), 6).alias("importance"), ds.passes_gate(t, F.col("kind"), F.col("score"), policy.KINDS).alias("passes"), domain.alias("domain"))


_CANON = ds.canonical_map(SYNONYMS)
_CANON_SQL = lambda w: "CASE " + " ".join(f"WHEN {w} = '{k}' THEN '{v}'" for k, v in _CANON.items()) + f" ELSE {w} END"
_KEY = lambda c, kind: f"{kind} || ':' || coalesce(nullif(array_to_string(list_transform(list_filter(regexp_extract_all(lower({c}), '[\\pL\\pN]+'), lambda w: length(w) > 2)[1:4], lambda w: {_CANON_SQL('w')}), '_'), ''), 'misc')"
_STOPS = _LIST(tx.STOP_WORDS)


@query("canonical_words", sql(f""" SELECT id, {_KEY('text', "'fact'")} AS key, len(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x) >= 4 AND NOT list_contains({_STOPS}, x)), lambda w: {_CANON_SQL('w')})))::int AS n_words, sha256(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS cache_key FROM msgs"""))
def canonical_words(spark, d):
    t = F.col("text")
    return messages(spark, d).select("id", ds.fact_key(t, F.lit("fact"), SYNONYMS).alias("key"), F.size(ds.canonical_tokens(t, SYNONYMS)).alias("n_words"), ds.cache_key(t).alias("cache_key"))


@query("expanded_search", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents)
SELECT doc_id FROM w WHERE list_has_any(w, ['hand', 'thand', 'wand']) AND list_has_any(w, ['the'])""")
def expanded_search(spark, d):
    terms = ds.expanded_terms(F.lit("Hand, the"), SYNONYMS)
    return ad.table(spark, d, "documents").where(ds.matches_expanded(F.col("text"), terms)).select("doc_id")


_ATOM_SQL = "list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: length(s) >= 15)[1:10]"


@query("distilled_facts", sql(f""", ok AS (SELECT * FROM msgs WHERE NOT {_DUMP} AND {_JUNK} IS NULL), a AS (SELECT id, user_id, generate_subscripts({_ATOM_SQL}, 1) - 1 AS place, unnest({_ATOM_SQL}) AS text FROM ok),
k AS (SELECT *, {_kind('text')} AS kind, {_TOPIC('text')} AS topic FROM a), n AS (SELECT *, {_KEY('text', 'kind')} AS key, id % 10 / 10 AS score FROM k),
f AS (SELECT user_id, key, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x) >= 3)) AS held FROM n WHERE id % 4 = 0),
t AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x) >= 3)) AS w FROM n),
x AS (SELECT t.id, t.place, any_value(t.text) AS text, any_value(t.kind) AS kind, any_value(t.topic) AS topic, any_value(t.key) AS key, any_value(t.score) AS score, coalesce(max(CASE WHEN len(w) + len(held) > 0 THEN len(list_intersect(w, held)) / len(list_distinct(list_concat(w, held))) END), 0) AS near
FROM t LEFT JOIN f ON t.user_id = f.user_id AND t.key = f.key GROUP BY t.id, t.place)
SELECT id, place::int AS place, kind, topic, key, CASE WHEN {_dialogic('text')} OR {_status('text')} THEN 'dropped' WHEN near > 0.85 THEN 'known' WHEN {_GATE('kind', 'score')} THEN 'l4' ELSE 'l3' END AS route FROM x"""))
def distilled_facts(spark, d):
    """Facts of every fourth message are held already."""
    m = messages(spark, d).withColumn("score", F.col("id") % 10 / 10)
    none = spark.createDataFrame([], "user_id string, key string, value string")
    held = ds.distilled(m.where("id % 4 = 0"), none, ["user_id"], SYNONYMS, policy.KINDS).select("user_id", "key", F.col("atom").alias("value"))
    return ds.distilled(m, held, ["user_id"], SYNONYMS, policy.KINDS).select("id", "place", "kind", "topic", "key", "route")


@query("close_reasons", sql(""" SELECT id, CASE WHEN id % 11 = 0 THEN 'keep' ELSE 'close' END AS action, CASE WHEN id % 11 = 0 THEN '' WHEN id % 7 = 0 THEN 'routed_direct' ELSE 'gated_out' END AS status,
CASE WHEN id % 11 = 0 THEN 'import' WHEN id % 7 = 0 THEN 'skip_distill_entry' WHEN trim(text) = '' THEN 'empty_text' WHEN id % 5 = 0 THEN 'internal_event' WHEN layer = 'agent' AND id % 2 = 0 THEN 'unstamped_writer' ELSE 'importance_gate_bypass' END AS reason FROM msgs"""))
def close_reasons(spark, d):
    m = messages(spark, d).select("id", "text", "layer", F.when(F.col("id") % 11 == 0, "import").otherwise("message").alias("raw_type"), F.when(F.col("id") % 5 == 0, "tick").otherwise("message").alias("event"), (F.col("id") % 7 == 0).alias("skip_distill"), (F.col("id") % 2 == 1).alias("decided"))
    return ds.close_reason(m)


TRIGGERS = {"preference": ["prefer", "like"], "lesson": ["error", "decided"], "experience": ["commit", "the"]}
_SENTENCES = "list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: length(s) >= 8)"


@query("closing_patterns", sql(f""", s AS (SELECT id, generate_subscripts({_SENTENCES}, 1) - 1 AS place, unnest({_SENTENCES}) AS sentence FROM msgs), t AS (SELECT *, CASE WHEN regexp_matches(lower(sentence), 'prefer|like') THEN 'preference' WHEN regexp_matches(lower(sentence), 'error|decided') THEN 'lesson' WHEN regexp_matches(lower(sentence), 'commit|the') THEN 'experience' END AS type FROM s)
SELECT id, place::int AS place, type, type || ':' || coalesce(nullif(array_to_string(list_filter(regexp_extract_all(lower(sentence), '[\\pL\\pN]+'), lambda w: length(w) > 2)[1:4], '_'), ''), 'misc') AS key FROM t WHERE type IS NOT NULL"""))
def closing_patterns(spark, d):
    return ds.closing_patterns(messages(spark, d), TRIGGERS).select("id", "place", "type", "key")


@query("parsed_uris", with_sql(""", u AS (SELECT entry_id, 'mem://' || user_id || CASE entry_id % 5 WHEN 0 THEN '/fact/' || key WHEN 1 THEN '/graph/node/' || entry_id::varchar WHEN 2 THEN '/episode/x' WHEN 3 THEN '/l0/' || entry_id::varchar || '/' ELSE '/nothing/1' END AS uri FROM facts)
SELECT entry_id, CASE WHEN entry_id % 5 IN (0, 1, 3) THEN split_part(uri, '/', 3) END AS layer, CASE entry_id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'graph' WHEN 3 THEN 'l0' END AS store, CASE entry_id % 5 WHEN 0 THEN split_part(uri, '/', 5) WHEN 1 THEN entry_id::varchar WHEN 3 THEN entry_id::varchar END AS key,
CASE entry_id % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'other' ELSE 'import' END AS channel FROM u""", "facts"))
def parsed_uris(spark, d):
    f = ad.facts(spark, d)
    kinds = [ds.build_uri("mem", F.col("user_id"), "fact", F.col("key")), F.concat(F.lit("mem://"), "user_id", F.lit("/graph/node/"), F.col("entry_id").cast("string")), F.concat(F.lit("mem://"), "user_id", F.lit("/episode/x")), F.concat(ds.build_uri("mem", F.col("user_id"), "l0", F.col("entry_id")), F.lit("/"))]
    uri = F.coalesce(*[F.when(F.col("entry_id") % 5 == k, u) for k, u in enumerate(kinds)], F.concat(F.lit("mem://"), "user_id", F.lit("/nothing/1")))
    source = F.when(F.col("entry_id") % 3 == 0, "Tool:mcp").when(F.col("entry_id") % 3 == 1, "elsewhere").otherwise(" import ")
    return f.select("entry_id", ds.parse_uri(uri, "mem").alias("u"), ds.channel_of(source).alias("channel")).select("entry_id", "u.*", "channel")


@query("recent_ring", with_sql(" SELECT id, user_id FROM journal QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) <= 50", "journal"))
def recent_ring(spark, d):
    return ds.numbered(ad.journal(spark, d), ["user_id"], 50).select("id", "user_id")


@query("null_kinds", with_sql(" SELECT entry_id, CASE WHEN entry_id % 6 = 0 THEN 'fact' ELSE memory_kind END AS memory_kind FROM facts", "facts"))
def null_kinds(spark, d):
    f = ad.facts(spark, d).withColumn("memory_kind", F.when(F.col("entry_id") % 6 != 0, F.col("memory_kind")))
    return f.fillna({"memory_kind": "fact"}).select("entry_id", "memory_kind")


@query("hourly_cap", with_sql(" SELECT log_id, row_number() OVER (PARTITION BY user_id, ts // 86400 ORDER BY ts, log_id) <= 2 AS allowed FROM audit", "audit"))
def hourly_cap(spark, d):
    """At most two a day for each user, the first ones."""
    return wn.capped_per_period(ad.audit(spark, d), ["user_id"], 86_400, 2).select("log_id", "allowed")
