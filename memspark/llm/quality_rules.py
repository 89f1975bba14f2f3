"""Quality rules whose limits follow the data: quantile sketches for each language and source.

Every text is measured with SQL functions alone. KLL sketches of each measure are
built for each (language, source), partly before the shuffle, and merged upwards
into sketches of the language and of all rows. The limits of a measure lie beyond a high and
a low quantile by a multiple of their distance, the one at which an exponential tail holds REJECT of
the rows. A measure that most rows have alike has no distance; its step then stands for it: what one symbol,
line or word is in the median text. One symbol, line or word more never
decides by itself. A leaf with too few rows takes its language's limits, and a language with too few those
of all rows. Measures and limits are then joined.

Sketches hold all values of up to SKETCH rows, so quantiles are exact there; beyond,
their rank is off by under 0.2 % of the rows (99 % confidence, the same after merging)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, read, written

#: Rows that a leaf or a language needs for limits of its own; sketch size (exact up to about this many rows).
LEAST_ROWS, SKETCH = 100, 2048
#: Share of the rows that a limit is to reject where the tail is exponential.
REJECT = 1 / 5000
#: Of each measure the high quantile; the low one is its mirror.
#: Junk is more than a tail of word lengths and symbols, so those start at the quartiles; repeats are rare in any text.
FENCES = {"word_length": 0.75, "symbols": 0.75, "dup_lines": 0.99, "repeats": 0.99}
#: What one of a measure's counts is a share of.
STEPS = {"symbols": "n_words", "dup_lines": "n_lines", "repeats": "n_words"}
#: Thresholds of at most this many leaves are broadcast; more are joined by a shuffle.
BROADCAST_LEAVES = 100_000
_BLANK = " \t\n\x0b\f\r"


def reach(q: float) -> float:
    """How many distances between the quantiles q and 1 - q a limit lies beyond q: an exponential tail's quantiles are -ln(1 - q)."""
    return (math.log(1 / REJECT) + math.log(1 - q)) / math.log(q / (1 - q))


def measured(docs: DataFrame, text: Column, carry: dict[str, Column]) -> DataFrame:
    """The columns in carry and the counts of each whole text.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words, all
    long. A null text counts as empty; all counts of a text without words are 0, but n_symbols."""
    kept = list(carry)
    d = docs.select(*[c.alias(k) for k, c in carry.items()], F.coalesce(text, F.lit("")).alias("_text"))
    bare = F.btrim("_text", F.lit(_BLANK))
    d = d.select(
        *kept,
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    counts = [F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols"]
    counts += [F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines")]
    window = F.expr("if(size(_words) < 5, cast(array() as array<bigint>), transform(slice(_words, 1, size(_words) - 4), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])))")
    d = d.select(*kept, *counts, window.alias("_windows"))
    base = [*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # Only texts in which a window repeats are sorted.
    d = d.select(*base, F.expr("if(size(array_distinct(_windows)) < size(_windows), sort_array(transform(_windows, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))").alias("_sorted"))
    d = d.select(*base, F.expr("sort_array(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h or x.h = get(_sorted, k + 1).h), x -> x.i))").alias("_starts"))
    repeats = F.expr("aggregate(transform(_starts, (p, k) -> least(5, coalesce(get(_starts, k + 1) - p, 5))), 0L, (a, b) -> a + b)")
    # A generator, so that filters on the counts stay above it and their expressions are not copied into the filters.
    return d.select(*kept, F.inline(F.array(F.struct(*base[len(kept) :], repeats.alias("n_repeat_words")))))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratios() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {"word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / words}


def _steps() -> dict[str, Column]:
    return {n: 1 / F.greatest(n, F.lit(1)) for n in dict.fromkeys(STEPS.values())}


def _fence(name: str) -> tuple[Column, Column]:
    at = lambda sketch, r: F.kll_sketch_get_quantile_double(sketch, F.lit(r))
    low, high = at(name, round(1 - FENCES[name], 9)), at(name, FENCES[name])
    spread = F.greatest(high - low, at(f"_per_{STEPS[name]}", 0.5)) if name in STEPS else high - low
    beyond = F.lit(reach(FENCES[name])) * spread
    return (low - beyond).alias(f"{name}_low"), (high + beyond).alias(f"{name}_high")


def limits(measures: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) of measures: lang, source and both fences of each ratio.

    Rows that fail the base rules don't count. A null lang or source is a value of its own.
    Fences are null (nothing is out of bounds) only where no row at all counts."""
    ratios = _ratios() | {f"_per_{k}": c for k, c in _steps().items()}
    rows = measures.withColumn("_counts", ~base_failed())
    part = lambda c: F.when(F.col("_counts"), c)
    leaf = cut(rows.groupBy(lang, source).agg(F.count_if("_counts").alias("n"), *[F.kll_sketch_agg_double(part(c), SKETCH).alias(k) for k, c in ratios.items()]))
    fences = [f for k in FENCES for f in _fence(k)]
    names = [f"{k}_{side}" for k in FENCES for side in ("low", "high")]
    of = lambda df: [F.when(F.col("n") > 0, f).alias(n) for n, f in zip(names, fences)]  # noqa: E731, ARG005
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in ratios]]
    seen = leaf.filter("n > 0")
    every = seen.agg(*merged).select(*of(seen)).first()
    langs = seen.groupBy(F.col(lang).alias("_lang")).agg(*merged).select("_lang", F.col("n").alias("_n"), *[f.alias(f"_{n}") for n, f in zip(names, of(seen))])
    own = leaf.select(lang, source, "n", *of(leaf)).join(langs, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    pick = lambda n: F.when(F.col("n") >= LEAST_ROWS, F.col(n)).when(F.col("_n") >= LEAST_ROWS, F.col(f"_{n}")).otherwise(F.lit(every[n]).cast("double"))
    return own.select(lang, source, *[pick(n).alias(n) for n in names])


def verdicts(measures: DataFrame, fences: DataFrame) -> DataFrame:
    """measures with base_failed and kept: false if the base rules fail or a ratio lies beyond its fence."""
    small = fences.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    f = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    both = measures.join(F.broadcast(f) if small else f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = F.lit(False)
    steps = _steps()
    for k, c in _ratios().items():
        less = c - steps[STEPS[k]] if k in STEPS else c
        out = out | F.coalesce((c < F.col(f"{k}_low")) | (less > F.col(f"{k}_high")), F.lit(False))
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~out).drop(*f.columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang, source; other columns don't matter.

    Returns one row per input row (repeats and null ids stay): doc_id, lang, source, the counts
    of measured(), base_failed and kept. Empty and null texts fail the base rules. Values equal
    to a fence are inside. An empty table gives no rows."""
    measures = cut(measured(docs, F.col("text"), {c: F.col(c) for c in ("doc_id", "lang", "source")}))
    return verdicts(measures, cut(limits(measures)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns and no others; each text is measured once."""
    row = {"_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "lang": F.col("lang"), "source": F.col("source")}
    measures = written(measured(docs, F.col("text"), row), "measures")
    return verdicts(measures, cut(limits(measures))).filter("kept").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_NAMES = list(FENCES)


def _sql_fences(groups: str, prefix: str) -> str:
    at = lambda n, q, side: f"list_sort(list({n}))[greatest(1, ceil({q} * count(*)))::int] AS {n}_{side}"
    cols = ", ".join(f"{at(n, round(1 - q, 9), 'low')}, {at(n, q, 'high')}" for n, q in FENCES.items())
    cols += "".join(f", {at(f'per_{n}', 0.5, 'mid')}" for n in dict.fromkeys(STEPS.values()))
    keys = f"{groups}, " if groups else ""
    return f"{prefix} AS (SELECT {keys}count(*) AS n, {cols} FROM r WHERE NOT base_failed {'GROUP BY ALL' if groups else ''})"


def _sql_out(n: str) -> str:
    q = lambda c: f"(CASE WHEN s.n >= {LEAST_ROWS} THEN s.{c} WHEN l.n >= {LEAST_ROWS} THEN l.{c} ELSE a.{c} END)"
    spread = f"{q(f'{n}_high')} - {q(f'{n}_low')}"
    spread, less = (f"greatest({spread}, {q(f'per_{STEPS[n]}_mid')})", f"r.{n} - r.per_{STEPS[n]}") if n in STEPS else (spread, f"r.{n}")
    beyond = f"{reach(FENCES[n])!r}::double * ({spread})"
    return f"coalesce(r.{n} < {q(f'{n}_low')} - {beyond} OR {less} > {q(f'{n}_high')} + {beyond}, false)"


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM v WHERE c > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols, len(l)::bigint AS n_lines, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(p.n, 0)::bigint AS n_repeat_words
  FROM t LEFT JOIN p ON t.doc_id = p.doc_id),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, word_chars / greatest(n_words, 1) AS word_length, n_symbols / greatest(n_words, 1) AS symbols,
  n_dup_lines / greatest(n_lines, 1) AS dup_lines, n_repeat_words / greatest(n_words, 1) AS repeats, 1 / greatest(n_words, 1) AS per_n_words, 1 / greatest(n_lines, 1) AS per_n_lines FROM m),
{_sql_fences("lang, source", "s")}, {_sql_fences("lang", "l")}, {_sql_fences("", "a")}
SELECT r.doc_id, r.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(map(_sql_out, _NAMES))}) AS kept
FROM r LEFT JOIN s ON r.lang IS NOT DISTINCT FROM s.lang AND r.source IS NOT DISTINCT FROM s.source LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang, a
"""
