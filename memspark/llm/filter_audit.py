"""Filter interaction audit: what each of five filters removes alone, after others, and on average over all orders.

A relational word pipeline gives the counts: texts are dealt once by document, exploded into words there, aggregated by
(document, word) and then by document into totals and distincts, with no shuffle of words. The other flags come
from narrow rows and are outer-joined (a text without words has no row of words). Copies are found by
SHA-256: the smallest id of each hash is pre-aggregated, and rows meet it by (hash, id), so a text of very many copies
is no hot key. Which filters a document fails is then one of 32 masks; all that any order of filters can remove follows
from 32 conditional counts for each part (times all, good and toxic documents), aggregated in one pass."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, read

FILTERS = "ABCDE"
_BLANK = " \t\n\x0b\f\r"
_MASKS, _COUNTED = range(32), ("all", "good", "toxic")


def words(text: Column) -> Column:
    """Maximal runs of characters that are not 0x20 or 0x09-0x0D; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.filter(F.split(bare, SPACES), lambda w: w != "")


def word_totals(docs: DataFrame) -> DataFrame:
    """docs: k1, k2 (together the name of a document) and text, a row or more of each. Returns k1, k2, n_words, n_distinct of those with words.

    Rows are dealt by document before words are exploded; both aggregations stay in those partitions."""
    # Rows with the same name have the same text; one of them does. Equal rows are merged before the shuffle.
    one = docs.groupBy("k1", "k2").agg(F.min("text").alias("text"))
    each = one.select("k1", "k2", F.explode(words(F.col("text"))).alias("word"))
    by_word = each.groupBy("k1", "k2", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("k1", "k2").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang; labels: doc_id, quality, toxic. Returns part, mask, good, toxic and n, the number of such documents.

    mask has bit 0 for filter A and so on. A null text is empty, a null lang the part ''. Rows that repeat count
    each. A null doc_id has no smaller one, is smaller than none, and has no label. A document with several labels is good
    (toxic) if one says so. Other columns don't matter. An empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    # The name of a document: its id (a hash of the text for lack of one) and a hash of its text.
    names = [F.coalesce("doc_id", F.xxhash64(F.lit(1), text)).alias("k1"), F.xxhash64(text).alias("k2")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    flags = rows.select(
        *names,
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)).alias("c"),
        text.rlike("[#$%&*|]").alias("d"),
    )
    flags = cut(flags.groupBy("k1", "k2", "doc_id", "part", "sha", "c", "d").agg(F.count("*").alias("n")))
    firsts = flags.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("sha", "doc_id", F.lit(True).alias("first"))
    counted = word_totals(rows.select(*names, "text"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k1")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # All three meet rows by document, or by hash and document; no key of these is hot.
    joined = flags.join(counted, ["k1", "k2"], "left").join(firsts, ["sha", "doc_id"], "left").join(marks, "k1", "left")
    total, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    has_id = F.col("doc_id").isNotNull()
    bits = [total < 200, 100 * distinct < 50 * total, F.col("c"), F.col("d"), has_id & F.col("first").isNull()]
    mask = sum((b.cast("int") * (1 << k) for k, b in enumerate(bits)), F.lit(0))
    yes = lambda c: has_id & F.coalesce(c, F.lit(False))
    return joined.groupBy("part", mask.alias("mask"), yes("good").alias("good"), yes("toxic").alias("toxic")).agg(F.sum("n").alias("n"))


def conditional_counts(found: DataFrame) -> DataFrame:
    """One row per part of failures(): part and, of all, good and toxic documents, 32 counts by mask (all_0 to toxic_31)."""
    which = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    cols = [F.sum(F.when(which[k] & (F.col("mask") == m), F.col("n")).otherwise(0)).alias(f"{k}_{m}") for k in _COUNTED for m in _MASKS]
    return found.groupBy("part").agg(*cols)


def _steps() -> Column:
    """All orders and steps: filter_order, step, the filter's bit and the bits of those before it."""
    found = []
    for order in permutations(range(len(FILTERS))):
        name = F.lit("".join(FILTERS[k] for k in order))
        for i, k in enumerate(order):
            found.append(F.struct(name.alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(1 << k).alias("bit"), F.lit(sum(1 << j for j in order[:i])).alias("before")))
    return F.inline(F.array(*found))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; see failures() for edge cases.

    shapley is what the step's filter removes, summed over all orders: a document that fails m filters is removed by each
    of them in 120 / m orders."""
    parts = conditional_counts(failures(docs, labels)).select("part", *[F.array(*[f"{k}_{m}" for m in _MASKS]).alias(k) for k in _COUNTED])
    # What stays after a set of filters, by set: documents whose mask meets none of it.
    stay = "transform(sequence(0, 31), s -> aggregate(sequence(0, 31), 0L, (t, m) -> t + if(m & s = 0, {0}[m], 0L))) AS {0}_stay"
    each = parts.selectExpr("part", "all", *[stay.format(k) for k in _COUNTED]).select("*", _steps())
    return each.selectExpr(
        "part",
        "filter_order",
        "step",
        "all_stay[before | bit] AS kept",
        "all_stay[before] - all_stay[before | bit] AS removed",
        "all_stay[0] - all_stay[bit] - all_stay[before] + all_stay[before | bit] AS redundant",
        "all[bit] AS unique_fails",
        "good_stay[before] - good_stay[before | bit] AS good_lost",
        "toxic_stay[before] - toxic_stay[before | bit] AS toxic_lost",
        "aggregate(sequence(0, 31), 0L, (t, m) -> t + if(m & bit = 0, 0L, all[m] * (120 div bit_count(m)))) AS shapley",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_FAILS = """len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)"""
ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, [{_FAILS}] AS fails FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(i, z) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
o AS (SELECT a.z || b.z || c.z || d.z || e.z AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, p, unnest(range(1, 6)) AS step FROM o),
v AS (SELECT part, filter_order, step, p[step] AS z, fails[p[step]] AS mine, list_sum(list_transform(p[1:step - 1], lambda k: fails[k]::int)) > 0 AS gone, list_sum(list_transform(fails, lambda k: k::int)) AS m, n, n_good, n_toxic FROM c, s),
g AS (SELECT part, filter_order, step, z, sum(n) FILTER (NOT coalesce(gone, false) AND NOT mine) AS kept, sum(n) FILTER (NOT coalesce(gone, false) AND mine) AS removed, sum(n) FILTER (gone AND mine) AS redundant,
  sum(n) FILTER (mine AND m = 1) AS unique_fails, sum(n_good) FILTER (NOT coalesce(gone, false) AND mine) AS good_lost, sum(n_toxic) FILTER (NOT coalesce(gone, false) AND mine) AS toxic_lost FROM v GROUP BY ALL)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
  coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, z))::bigint AS shapley FROM g
"""
