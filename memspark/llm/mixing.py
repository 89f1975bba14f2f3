"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

The token budget goes down a domain, language, source tree in proportion to the
weights. A node never gets more than its subtree can supply, so a leaf's shortage
goes to its siblings first, and what a whole subtree can't supply goes to its
ancestors' siblings. A leaf spends its budget on whole epochs and then on a prefix
of the next epoch's seeded order. Prefixes are found from token sums of 4096 hash
ranges of a leaf; only the range in which the budget ends is put in order, so a
leaf with a third of all rows is never sorted or gathered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, read

LEAF = ["_domain", "_lang", "_source"]
#: Plans of at most this many leaves are broadcast; more are joined by a shuffle.
BROADCAST_LEAVES = 100_000
#: Hex digits of the order key that name a hash range.
RANGE_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """domain, lang, source: columns of docs; *_weight: whole numbers, over 0 or no budget (null too).
    share: budget as a share of all tokens, in thousandths; max_epochs: passes over a leaf at most."""

    domain: Column
    domain_weight: Column
    lang_weight: Column
    source_weight: Column
    share: int = 500
    max_epochs: int = 2
    seed: int = 17


def token_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def _fill(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """nodes: cap, w and budget (of the parent); the node's budget replaces the parent's.

    Nodes that run dry are those with the least cap for their weight; the level at which the
    rest stand is the largest that the first node left over can hold."""
    by = Window.partitionBy(*parent).orderBy("_ratio", node)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    dry = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = nodes.withColumn("_live", F.col("w") > 0).withColumn("_ratio", F.when(F.col("_live"), F.col("cap") / F.col("w")))
    n = n.withColumn("_level", F.when(F.col("_live"), (F.col("budget") - dry) / F.sum("w").over(rest)))
    n = n.withColumn("_at", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(Window.partitionBy(*parent)))
    given = F.when(~F.col("_live"), 0).when(F.col("_at").isNull(), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("_at") * F.col("w"))))
    return n.withColumn("budget", F.greatest(given, F.lit(0)).cast("long")).drop("_live", "_ratio", "_level", "_at")


def _safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on keys of which null equals null; b's keys go."""
    b = b.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = [a[k].eqNullSafe(b[f"{k}_r"]) for k in keys]
    return a.join(F.broadcast(b) if small else b, on, how).drop(*[f"{k}_r" for k in keys])


def budgets(rows: DataFrame, share: int, max_epochs: int) -> DataFrame:
    """rows: _domain, _lang, _source, the weights _dw, _lw, _sw and _tokens.

    Returns one row per leaf: its keys, tokens (of one epoch) and budget, in tokens."""
    live = (F.col("_dw") > 0) & (F.col("_lw") > 0) & (F.col("_sw") > 0)
    w = [F.when(F.coalesce(live, F.lit(False)), F.col(c)).otherwise(0).cast("long").alias(c) for c in ("_dw", "_lw", "_sw")]
    leaves = cut(rows.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens"), *[F.max(c).alias(c) for c in ("_dw", "_lw", "_sw")]).select(*LEAF, "tokens", *w).withColumn("cap", F.when(F.col("_dw") > 0, F.col("tokens") * max_epochs).otherwise(0)))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    top = leaves.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.max("_dw").alias("w")).withColumn("budget", F.lit(total * share // 1000))
    top = _fill(top, [], "_domain").select("_domain", "budget")
    mid = _safe(leaves.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"), F.max("_lw").alias("w")), top, ["_domain"])
    mid = _fill(mid, ["_domain"], "_lang").select("_domain", "_lang", "budget")
    low = _safe(leaves.withColumnRenamed("_sw", "w"), mid, ["_domain", "_lang"])
    return _fill(low, ["_domain", "_lang"], "_source").select(*LEAF, "tokens", "budget")


def _range(key: Column) -> Column:
    return F.conv(F.substring(key, 1, RANGE_DIGITS), 16, 10).cast("int")


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("_id").cast("string")))


def leaf_plans(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows as for budgets, with _id. One row per leaf: full (whole epochs), rest (tokens of the next),
    upto (hash ranges wholly taken from it), edge (the range in which rest ends), before (tokens up to edge)."""
    b = budgets(rows, mix.share, mix.max_epochs)
    live = F.col("tokens") > 0
    full = F.when(live, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long")
    plan = cut(b.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")))
    small = plan.count() <= BROADCAST_LEAVES
    at = _safe(rows, plan.select(*LEAF, "full", "rest"), LEAF, small=small).withColumn("_range", _range(_key(mix.seed, F.col("full") + 1)))
    sums = at.groupBy(*LEAF, "_range").agg(F.sum("_tokens").alias("sum"), F.max("rest").alias("rest"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*LEAF).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    after = F.col("before") + F.col("sum")
    inside, edge = after < F.col("rest"), (F.col("before") < F.col("rest")) & (F.col("rest") <= after)
    ends = sums.groupBy(*LEAF).agg(F.max(F.when(inside, F.col("_range"))).alias("upto"), F.max(F.when(edge, F.col("_range"))).alias("edge"), F.max(F.when(edge, F.col("before"))).alias("before"))
    return cut(_safe(plan, ends, LEAF, "left").select(*LEAF, "full", "rest", "upto", "edge", "before"))


def mixed(docs: DataFrame, mix: Mix, carry: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The columns in carry, n_tokens and copies (how often the row goes into the mixture; 0: not).

    Row order within an epoch: md5 of seed, epoch and id (null ids share a place), then id, then
    tokens; equal rows are interchangeable. Null domains, languages and sources are values of their
    own. Empty texts have 0 tokens and take part in prefixes. The row in which a budget ends is
    taken whole; a budget of 0 takes none. An empty table gives no rows."""
    at = {"_id": F.col(id_col), "_domain": mix.domain, "_lang": F.col(lang_col), "_source": F.col(source_col), "_tokens": token_count(F.col(text_col))}
    weights = {"_dw": mix.domain_weight, "_lw": mix.lang_weight, "_sw": mix.source_weight}
    rows = cut(docs.select(*[c.alias(k) for k, c in {**at, **weights}.items()]))
    plan = leaf_plans(rows, mix)
    small = plan.count() <= BROADCAST_LEAVES
    wide = docs.select(*[c.alias(k) for k, c in carry.items()], *[c.alias(k) for k, c in at.items()])
    wide = _safe(wide, plan, LEAF, small=small).withColumn("_key", _key(mix.seed, F.col("full") + 1)).withColumn("_range", _range(F.col("_key")))
    on_edge = F.coalesce(F.col("_range") == F.col("edge"), F.lit(False))
    sure = wide.filter(~on_edge).withColumn("copies", F.col("full") + F.coalesce(F.col("_range") <= F.col("upto"), F.lit(False)).cast("long"))
    order = Window.partitionBy(*LEAF).orderBy("_key", "_id", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("_tokens").over(order), F.lit(0))
    cut_off = wide.filter(on_edge).withColumn("copies", F.col("full") + (so_far < F.col("rest")).cast("long"))
    out = [*carry, F.col("_tokens").alias("n_tokens"), "copies"]
    return sure.select(*out).unionByName(cut_off.select(*out))


def take(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mixture: each row of docs as often as mixed() says, with all its columns and no others."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = mixed(docs, mix, {"_row": row}).filter("copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def production_mix(share: int = 500, max_epochs: int = 2) -> Mix:
    n = F.regexp_extract("source", "^src([0-9]{1,6})$", 1)
    number = F.when(n != "", n.cast("int"))
    domain = F.when(number < 5, "web").when(number < 10, "forum").when(number < 15, "books").otherwise("reference")
    return Mix(
        domain=domain,
        domain_weight=F.when(domain == "web", 4).when(domain == "forum", 2).when(domain == "books", 3).otherwise(1),
        lang_weight=F.when(F.col("lang") == "en", 4).when(F.col("lang").isin("de", "es", "fr"), 2).otherwise(1),
        source_weight=F.lit(1),
        share=share,
        max_epochs=max_epochs,
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = production_mix()
    carry = {"doc_id": F.col("doc_id"), "domain": mix.domain, "lang": F.col("lang"), "source": F.col("source")}
    return mixed(read(spark, sf_dir, "documents"), mix, carry)


def _sql_fill(name: str, of: str, parent: str, node: str, keys: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_l AS (SELECT *, (budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({part} ORDER BY cap / w, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {of}),
{name}_a AS (SELECT *, max(CASE WHEN level <= cap / w THEN level END) OVER ({part}) AS stand FROM {name}_l),
{name} AS (SELECT {keys}, greatest(CASE WHEN stand IS NULL THEN cap ELSE least(cap, floor(stand * w)) END, 0)::bigint AS budget FROM {name}_a)"""


ORACLE_SQL = rf"""
WITH n AS (SELECT *, CASE WHEN regexp_full_match(source, 'src[0-9]{{1,6}}') THEN source[4:]::int END AS k, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint AS n_tokens FROM documents),
t AS (SELECT doc_id, lang, source, n_tokens, CASE WHEN k < 5 THEN 'web' WHEN k < 10 THEN 'forum' WHEN k < 15 THEN 'books' ELSE 'reference' END AS domain FROM n),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::bigint AS tokens, sum(n_tokens)::bigint * 2 AS cap, 1 AS w,
  CASE domain WHEN 'web' THEN 4 WHEN 'forum' THEN 2 WHEN 'books' THEN 3 ELSE 1 END AS dw, CASE WHEN lang = 'en' THEN 4 WHEN lang IN ('de', 'es', 'fr') THEN 2 ELSE 1 END AS lw FROM t GROUP BY ALL),
top_in AS (SELECT domain, sum(cap)::bigint AS cap, max(dw) AS w, (SELECT sum(tokens)::bigint * 500 // 1000 FROM leaf) AS budget FROM leaf GROUP BY domain),
{_sql_fill("top", "top_in", "", "domain", "domain")},
mid_in AS (SELECT l.domain, l.lang, sum(cap)::bigint AS cap, max(lw) AS w, max(top.budget) AS budget FROM leaf l JOIN top ON l.domain = top.domain GROUP BY ALL),
{_sql_fill("mid", "mid_in", "domain", "lang", "domain, lang")},
low_in AS (SELECT l.domain, l.lang, l.source, tokens, cap, w, mid.budget FROM leaf l JOIN mid ON l.domain = mid.domain AND l.lang IS NOT DISTINCT FROM mid.lang),
{_sql_fill("low", "low_in", "domain, lang", "source", "domain, lang, source, tokens")},
p AS (SELECT t.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_epochs, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
  FROM t JOIN low ON t.domain = low.domain AND t.lang IS NOT DISTINCT FROM low.lang AND t.source IS NOT DISTINCT FROM low.source),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || (full_epochs + 1)::varchar || ':' || doc_id::varchar), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, domain, lang, source, n_tokens, (full_epochs + (before < rest)::int)::bigint AS copies FROM c
"""
