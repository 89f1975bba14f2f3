"""Retrieval: postings and BM25, binary search, source fan-in, fusion, re-ranking and routing.

All operators take a table of queries (query_id, query), so many queries share one pass."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from . import windows as wn

K1, B = 1.2, 0.75
#: Query terms that are looked for in each text at most, and queries and vectors of a block.
MOST_TERMS, QUERY_BLOCK, VECTOR_BLOCK = 1000, 512, 4096


def terms(df: DataFrame, ident: str, *texts: str) -> DataFrame:
    """One row per word occurrence: ident, term."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(tx.WORD), 1)
    return df.select(ident, F.explode(words).alias("term"))


def postings(df: DataFrame, ident: str, *texts: str) -> tuple[DataFrame, DataFrame]:
    """(term, ident, tf, dl) and one row (n, avgdl). Store both to serve many queries."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(tx.WORD), 1)
    sized = df.select(ident, words.alias("_w")).select(ident, "_w", F.size("_w").alias("dl"))
    counts = sized.select(ident, "dl", F.explode("_w").alias("term")).groupBy("term", ident).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return counts, sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def asked_postings(df: DataFrame, ident: str, queries: DataFrame, *texts: str) -> tuple[DataFrame, DataFrame]:
    """postings() of the queries' terms alone, without an index: each text is read once and its hits are counted in place.

    The terms of all queries go to every task as one array, so this is for query sets of at most MOST_TERMS terms;
    more terms go by way of postings(). Only (ident, length, hits) are kept between the two results."""
    found = queries.select(F.explode(tx.tokens(F.col("query"), 1)).alias("term")).distinct()
    if found.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        return postings(df, ident, *texts)
    wanted = found.agg(F.collect_set("term").alias("_asked"))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(tx.WORD), 1)
    sized = df.select(ident, words.alias("_w")).crossJoin(F.broadcast(wanted))
    narrow = sized.select(ident, F.size("_w").alias("dl"), F.filter("_w", lambda x: F.array_contains("_asked", x)).alias("_h")).persist()
    counts = narrow.select(ident, "dl", "_h", F.explode(F.array_distinct("_h")).alias("term")).select("term", ident, F.size(F.filter("_h", lambda x: x == F.col("term"))).cast("long").alias("tf"), "dl")
    return counts, narrow.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, ident: str) -> DataFrame:
    """query_id, ident, score: Okapi BM25, higher is better. Only the postings of query terms are read on."""
    asked = queries.select("query_id", F.explode(tx.tokens(F.col("query"), 1)).alias("term"))
    hit = index.join(F.broadcast(asked), "term")
    df = hit.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    scored = hit.join(F.broadcast(df), ["query_id", "term"]).crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", ident).agg(F.sum(part).alias("score"))


def top(df: DataFrame, keys: list[str], ident: str, most: int, score: str = "score") -> DataFrame:
    """The best rows of each key by rounded score, then id (the filter on the rank bounds what each task keeps)."""
    return wn.newest(df, keys, most, F.desc(F.round(score, 6)), F.asc(ident))


def core_hits(facts: DataFrame, queries: DataFrame, weight: float = 1.0) -> DataFrame:
    """Facts with a word of the query: importance x intent x kind."""
    from ..functions.policy import kind_weight

    hit = _holding(facts, queries, "entry_id", F.concat_ws(" ", "key", "value")).join(facts.select("entry_id", "importance", "memory_kind", "created_at"), "entry_id")
    score = F.col("importance") * weight * kind_weight(F.col("memory_kind"))
    return hit.select("query_id", F.lit("core").alias("source"), F.col("entry_id").alias("native_id"), score.alias("score"), "created_at")


def episode_hits(episodes: DataFrame, queries: DataFrame, weight: float = 1.0) -> DataFrame:
    hit = _holding(episodes, queries, "episode_id", F.col("summary")).join(episodes.select("episode_id", "weight", "created_at"), "episode_id")
    return hit.select("query_id", F.lit("episodic").alias("source"), F.col("episode_id").alias("native_id"), (F.col("weight") * weight).alias("score"), "created_at")


def _holding(rows: DataFrame, queries: DataFrame, ident: str, hay: Column) -> DataFrame:
    """query_id and ident of the rows whose text holds a word of three letters or more of a query; texts pass one automaton."""
    from .matching import occurrences

    asked = queries.select("query_id", F.explode(F.split(F.lower("query"), " ")).alias("pattern")).where(F.length("pattern") >= 3).distinct()
    found = occurrences(rows.select(ident, F.lower(hay).alias("_hay")), [ident], "_hay", asked)
    return found.select(ident, "pattern").join(asked, "pattern").select("query_id", ident).distinct()


def recall(sources: list[DataFrame], now: int, limit: int = 10) -> DataFrame:
    """Fan-in of hits (query_id, source, native_id, score, created_at), 2 x limit of each source, merged by rank."""
    pool = None
    for hits in sources:
        best = wn.newest(hits, ["query_id"], 2 * limit, F.desc(F.round("score", 6)), F.asc("native_id"))
        pool = best if pool is None else pool.unionByName(best)
    return wn.merge_ranked(pool, now, ["query_id"], limit)


def nearest(vectors: DataFrame, queries: DataFrame, scores, limit: int, shape: str) -> DataFrame:
    """The best `limit` vectors of each query, in blocks: vectors and queries (id, v) meet block by block, each pair of
    blocks gives its best alone, and those are ranked. scores(vectors, queries) gives a matrix of whole numbers or
    floats, higher is better; ties go to the smaller id. Nothing is broadcast, and no block outgrows a task.

    shape: type of the score. Returns query_id, vec_id and score."""
    nq, nv = (max(1, math.ceil(df.count() / size)) for df, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    # Both sides' numbers are ints: those of other types are hashed otherwise, and equal blocks wouldn't meet.
    part = lambda df, n, mine, other, m: df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = part(vectors, nv, "_v", "_q", nq), part(queries, nq, "_q", "_v", nv)

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = v.sort_values("id")
        found = scores(v, q)
        order = np.argsort(-found, axis=0, kind="stable")[:limit]
        ids = v["id"].to_numpy()
        return pd.DataFrame({"query_id": np.tile(q["id"].to_numpy(), len(order)), "vec_id": ids[order].ravel(), "score": np.take_along_axis(found, order, 0).ravel()})

    keys = ["_v", "_q"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id long, vec_id long, score {shape}")
    return wn.newest(met, ["query_id"], limit, F.desc("score"), F.asc("vec_id"))


def cosine_search(vectors: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """vectors (vec_id, embedding), queries (query_id, embedding): the nearest by cosine, themselves left out; scores of 6 digits."""

    def scores(v: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
        x, y = (np.vstack(p["v"].to_numpy()).astype(np.float64) for p in (v, q))
        size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
        s = np.round(np.divide(x @ y.T, size, out=np.zeros(size.shape), where=size > 0), 6)
        s[v["id"].to_numpy()[:, None] == q["id"].to_numpy()] = -np.inf
        return s

    found = nearest(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v")), scores, limit, "double")
    return found.where(F.col("score") >= -1.5)


def binary_search(vectors: DataFrame, query_bits: DataFrame, limit: int = 10, width: int = 64) -> DataFrame:
    """vectors (vec_id, bits), query_bits (query_id, qbits): the nearest by Hamming distance, score 1 - d/width."""

    def scores(v: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
        x, y = (p["v"].to_numpy(np.int64).view(np.uint64) for p in (v, q))
        return -np.bitwise_count(x[:, None] ^ y).astype(np.int64)

    best = nearest(vectors.select(F.col("vec_id").alias("id"), F.col("bits").alias("v")), query_bits.select(F.col("query_id").alias("id"), F.col("qbits").alias("v")), scores, limit, "long")
    return best.select("query_id", "vec_id", (-F.col("score")).alias("distance"), (1 + F.col("score") / width).alias("score"))


def bits_of(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", sc.sign_bits(F.col("embedding")).alias("bits"))


def hybrid(branches: list[DataFrame], importance: DataFrame, ident: str) -> DataFrame:
    """Best score of each id over the branches, blended with its importance: 0.7 to 0.3."""
    pool = branches[0]
    for b in branches[1:]:
        pool = pool.unionByName(b)
    best = pool.groupBy("query_id", ident).agg(F.max("score").alias("best"))
    return best.join(importance, ident, "left").select("query_id", ident, (0.7 * F.col("best") + 0.3 * F.coalesce("importance", F.lit(0.0))).alias("score"))


def kind_boost(query: Column, keywords: list[str]) -> Column:
    """0.1 for each of a kind's keywords in the query, 0.5 at most."""
    return F.least(F.lit(0.5), 0.1 * F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(query), k))))


def rerank(pool: DataFrame, threshold: float = 0.05, most: int = 100) -> DataFrame:
    """pool: query_id, query, id, content, score; at most `most` candidates of each query are looked at.

    Greedy: each pick takes the most of relevance (scores after lateral inhibition, scaled) and of the query's
    words not covered yet, less its likeness to what was picked before. Scores are scaled by the best, those
    under the threshold go. n_eff is the effective number of sources, abstain whether it is under 1.5.
    Each pick depends on all before it, so a query's candidates are one bounded pandas group."""
    best = wn.newest(pool, ["query_id"], most, F.desc("score"), F.asc("id")).select("query_id", "query", "id", "content", "score")
    return best.groupBy("query_id").applyInPandas(lambda p: _greedy(p, threshold), f"query_id {pool.schema['query_id'].dataType.simpleString()}, id {pool.schema['id'].dataType.simpleString()}, score double, raw_activation double, n_eff double, abstain boolean")


def _word_set(text: str) -> frozenset[str]:
    return frozenset(w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if len(w) >= 3)


def inhibit(scores: list[float], beta: float = 0.15, most: int = 7) -> list[float]:
    ordered = sorted(scores, reverse=True)
    return [max(0.0, s - beta * sum(v - s for v in [v for v in ordered if v > s][:most])) for s in scores]


def _greedy(p: pd.DataFrame, threshold: float) -> pd.DataFrame:
    p = p.sort_values(["score", "id"], ascending=[False, True])
    raw = inhibit(p["score"].tolist())
    low, high = min(raw), max(raw)
    relevance = [1.0 if high - low < 1e-12 else (r - low) / (high - low) for r in raw]
    wanted, words = _word_set(p["query"].iloc[0]), [_word_set(c) for c in p["content"]]
    left, gained, covered, nearest = list(range(len(p))), [0.0] * len(p), set(), [0.0] * len(p)
    while left:
        gain = {i: relevance[i] + 0.8 * (len((words[i] & wanted) - covered) / len(wanted) if wanted else 0.0) - nearest[i] for i in left}
        pick = max(left, key=lambda i: (gain[i], -i))
        gained[pick] = gain[pick]
        left.remove(pick)
        covered |= words[pick] & wanted
        for i in left:
            union = len(words[i] | words[pick])
            nearest[i] = max(nearest[i], len(words[i] & words[pick]) / union if union else 0.0)
    top_gain = max(gained)
    final = [max(0.0, g) / top_gain if top_gain > 0 else 0.0 for g in gained]
    total = sum(final)
    n_eff = 1 / sum((f / total) ** 2 for f in final) if total > 0 else 0.0
    out = pd.DataFrame({"query_id": p["query_id"], "id": p["id"], "score": final, "raw_activation": [round(r, 4) for r in raw], "n_eff": round(n_eff, 3), "abstain": top_gain > 0 and n_eff < 1.5})
    return out[out["score"] >= threshold].sort_values("score", ascending=False, kind="stable")


def confidence(hits: DataFrame, content: str = "content") -> DataFrame:
    """Share of each query's words that its hits cover (hits: query_id, query, content; the best ten)."""
    covered = hits.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(tx.tokens(F.col(content))))).alias("seen"), F.first("query").alias("query"))
    wanted = tx.tokens(F.col("query"))
    return covered.select("query_id", F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, "seen")) / F.size(wanted)).otherwise(0.0).alias("confidence"))


def pack_budget(candidates: DataFrame, keys: list[str], order: list[Column], budget: int, text: str = "text") -> DataFrame:
    """Candidates in order while their estimated tokens stay within the budget; near-repeats (first 80 characters) count once."""
    c = candidates.withColumn("_k", F.substring(F.regexp_replace(F.lower(text), "\\s+", " "), 1, 80))
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_k").orderBy(*order))).where("_n = 1")
    used = F.sum(tx.estimate_tokens(F.col(text))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("used_tokens", used).where(F.col("used_tokens") <= budget).drop("_k", "_n")


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))
