"""Toxic passages by maximum-scoring segments.

Every word scores its log-odds between toxic and clean texts under a Dirichlet prior;
a word too rare to judge takes the score of its longest known beginning, and all others
a small negative score. A linear scan finds all maximal-scoring segments of a text. The
number of segments expected by chance follows the extreme-value law E = K n exp(-lambda S).
A text's evidence is that of its r best segments together, by the law for sums of
such scores, at the r for which it is strongest, each further segment halving it; its
toxicity is a logistic curve over the evidence.

Labelled rows are fitted in three folds. Near copies (fingerprints linked at two bits)
share a fold and one text's weight between them. What a word must show to be listed is
chosen by the log loss of texts scored by the words of the other folds, and from such
scores lambda, K and the curve are fitted, too. Held-out rows take no part in any of it."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held_out, read, words_of
from .components import connected_components
from .simhash import fingerprint_udf, variant_links

#: Labelled rows fitted at most (those with the smallest hash of doc_id).
FIT_ROWS = 20_000
#: Bytes of the beginnings that stand in for rare words; the prior's weight in texts; least log-odds of a listed word.
BEGINNINGS, PRIOR, LEAST_ODDS = (10, 8, 7, 6, 5, 4), 5.0, 1.5
#: What a listed word may have to show: (z value of its log-odds, toxic texts that hold it). One pair is chosen when fitting.
SETTINGS = ((3.0, 3), (3.0, 10), (4.5, 10), (6.0, 10))
#: Folds of the labelled rows; a text's weight, which near copies share.
FOLDS, WHOLE = 3, 1 << 20
#: Score of a word that isn't listed; a passage is reported if less than this number is expected by chance.
OTHER, REPORT_E = -0.05, 0.05
_EDGES = b".,;:!?\"'()[]{}#*$%&|<>-_"
_MEMO = 400_000


@dataclass
class Model:
    listed: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 1e-3
    slope: float = 1.0
    offset: float = -1.1


class _Scores(dict):
    """Scores of raw words, kept as they come up; forgotten when there are too many."""

    def __init__(self, listed: dict[bytes, float]):
        super().__init__()
        self.listed = listed

    def __missing__(self, word: bytes) -> float:
        bare, got = word.strip(_EDGES), self.listed.get
        s = got(b"=" + bare)
        for n in BEGINNINGS if s is None else ():
            if len(bare) >= n and (s := got(bare[:n])) is not None:
                break
        if len(self) >= _MEMO:
            self.clear()
        self[word] = s = OTHER if s is None else s
        return s


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, past the last, score) of a sequence, in linear time.

    A list of candidates is kept with the running total before and after each; a new positive
    item swallows candidates back to the last one that started lower, if it ends higher."""
    held: list[list] = []  # first, end, total before, total after, index of the last candidate with a smaller total before
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s, len(held) - 1]
        total += s
        while True:
            j = new[4]
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            new[4] = j
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], i + 1, held[j][2], new[3], held[j][4]]
            del held[j:]
    return [(a, b, r - left) for a, b, left, r, _ in held]


def segments_of(words: list[bytes], scores: _Scores) -> list[tuple[int, int, float]]:
    """The maximal segments of a text; stretches of words that aren't listed are taken in one step."""
    items, places, last = [], [], -1
    for i, w in enumerate(words):
        if (s := scores[w]) > 0:
            if i > last + 1:
                items.append(OTHER * (i - last - 1))
                places.append(i - 1)
            items.append(s)
            places.append(i)
            last = i
    return [(places[a], places[b - 1] + 1, s) for a, b, s in maximal_segments(items)]


def expected(model: Model, n: int, score: float) -> float:
    """How many segments of this score or more chance brings in n words."""
    return model.k * max(n, 1) * math.exp(-min(model.rate * score, 700))


def evidence(model: Model, n: int, scores: list[float]) -> float:
    """-ln of the chance of the r best segments in n words, at the best r; 0 to 60."""
    best, total, chance = 0.0, 0.0, math.log(max(model.k * max(n, 1), 1e-12))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = model.rate * s - chance
        if x <= 0:
            break
        total += x
        if r == 1 or total > r:
            best = max(best, total - (r - 1) * math.log(max(total, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return min(best, 60.0)


def _tokens(text: str) -> set[bytes]:
    out = set()
    for w in set(words_of(text)):
        bare = w.strip(_EDGES)
        if bare:
            out.add(b"=" + bare)
            out.update(bare[:n] for n in BEGINNINGS if len(bare) >= n)
    return out


def _sample(docs: DataFrame, labels: DataFrame, held: tuple[int, int] | None, rows: int) -> DataFrame:
    """y, text, fold and weight of the labelled rows that are fitted."""
    ids = labels.filter("doc_id is not null and toxic in (0, 1)")
    if held:
        ids = ids.filter(~held_out(F.col("doc_id"), *held))
    ids = ids.select("doc_id", F.col("toxic").cast("int").alias("y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    sample = docs.select("doc_id", "text").filter("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").join(F.broadcast(ids), "doc_id")
    sample = cut(sample.select("y", "text", fingerprint_udf("text").alias("fp")))
    alike = connected_components(variant_links(sample.select("fp").distinct())).withColumnRenamed("node", "fp")
    named = sample.join(alike, "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    weight = F.floor(F.lit(WHOLE) / F.count("*").over(Window.partitionBy("y", "group"))).cast("long")
    return cut(named.select("y", "text", F.pmod(F.xxhash64("group"), F.lit(FOLDS)).cast("int").alias("fold"), weight.alias("weight")))


def _judge(c, t, nc: float, nt: float, total: float, all_, log, sqrt, high):
    """Log-odds of a word in t of nt toxic and c of nc clean texts, and their z value. Works on numbers and on columns."""
    prior = 0.5 + PRIOR * all_ / total
    odds = log(t + prior) - log(high(nt - t) + PRIOR + 1 - prior) - log(c + prior) + log(high(nc - c) + PRIOR + 1 - prior)
    return odds, odds / sqrt(1 / (t + prior) + 1 / (c + prior))


def _candidates(sample: DataFrame) -> tuple[list, np.ndarray]:
    """Words and beginnings that some set of folds could list, with their weights [y][fold], and those of all texts."""
    seen = np.zeros((2, FOLDS))
    for r in sample.groupBy("y", "fold").agg(F.sum("weight").alias("n")).collect():
        seen[r.y, r.fold] = r.n / WHOLE

    def count(batches):
        for b in batches:
            got: dict[bytes, list[int]] = {}
            for y, fold, weight, text in zip(b["y"], b["fold"], b["weight"], b["text"]):
                for t in _tokens(text):
                    got.setdefault(t, [0] * (2 * FOLDS))[y * FOLDS + fold] += weight
            yield pd.DataFrame([(t, *n) for t, n in got.items()], columns=["token", *names])

    names = [f"n{k}" for k in range(2 * FOLDS)]
    if not (seen.sum(1) > 0).all():
        return [], seen
    counts = sample.mapInPandas(count, "token binary, " + ", ".join(f"{n} long" for n in names)).groupBy("token").agg(*[F.sum(n).alias(n) for n in names])
    fits = F.lit(False)
    for out in range(-1, FOLDS):
        used = [f for f in range(FOLDS) if f != out]
        c, t = (sum((F.col(names[y * FOLDS + f]) for f in used), F.lit(0)) / WHOLE for y in (0, 1))
        nc, nt = (float(seen[y, used].sum()) for y in (0, 1))
        if nc and nt:
            odds, z = _judge(c, t, nc, nt, nc + nt, c + t, F.log, F.sqrt, lambda x: F.greatest(x, F.lit(0.0)))
            fits = fits | ((odds >= LEAST_ODDS) & (z >= min(z for z, _ in SETTINGS)) & (t >= min(n for _, n in SETTINGS) - 1e-3))
    return [(bytes(r.token), np.array(r[1:], float).reshape(2, FOLDS) / WHOLE) for r in counts.filter(fits).collect()], seen


def _listed(candidates: list, seen: np.ndarray, setting: tuple[float, int], out: int = -1) -> dict[bytes, float]:
    """The words that all folds but `out` list, with their log-odds."""
    used = [f for f in range(FOLDS) if f != out]
    (nc, nt), found = seen[:, used].sum(1), {}
    for token, n in candidates if nc and nt else ():
        c, t = n[:, used].sum(1)
        odds, z = _judge(c, t, nc, nt, nc + nt, c + t, math.log, math.sqrt, lambda x: max(x, 0.0))
        if odds >= LEAST_ODDS and z >= setting[0] and t >= setting[1] - 1e-3:
            found[token] = round(float(odds), 6)
    return found


def _chance_rate(values: list[float], hits: np.ndarray, words: float) -> float:
    """lambda: the positive root of E[exp(lambda s)] = 1 for the words of clean texts."""
    s, n = np.array(values), hits + 0.5 / len(values)
    p = n / max(words, n.sum() * 2)
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p @ np.exp(np.minimum(mid * s, 600))) + (1 - p.sum()) * np.exp(mid * OTHER) < 1 else (low, mid)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's method for sigmoid(a x + b), with a slight pull to a = 0."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = np.maximum(p * (1 - p), 1e-9) * weight, (p - y) * weight
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(g * x).sum() + 1e-2 * a, g.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -4, 4)
    return float(a), float(b)


def fit_sample(docs: DataFrame, labels: DataFrame, held: tuple[int, int] | None = (5, 0), rows: int = FIT_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic). Learns from at most `rows` labels 0 or 1 whose rows aren't held
    out (those with the smallest hash of doc_id). Null ids and labels and texts without words don't count. Only
    words that may be listed, sums and one number for each fitted row and setting come to the driver."""
    sample = _sample(docs, labels, held, rows)
    candidates, seen = _candidates(sample)
    nc, nt = seen.sum(1)
    if not candidates:
        return Model(offset=math.log((nt + 0.5) / (nc + 1.5)))
    lists = [[_listed(candidates, seen, s, f) for f in range(FOLDS)] for s in SETTINGS]

    def spread(batches):
        """Of clean texts: (setting, kind, value) with weights; kind 0: words by score, 1: segments by score, 2: words in all."""
        scores = [[_Scores(f) for f in s] for s in lists]
        for b in batches:
            got: Counter = Counter()
            for y, fold, weight, text in zip(b["y"], b["fold"], b["weight"], b["text"]):
                words = words_of(text) if not y else []
                for k, own in enumerate(scores) if words else ():
                    got[k, 2, 0.0] += weight * len(words)
                    for v in map(own[fold].__getitem__, words):
                        if v > 0:
                            got[k, 0, round(v, 2)] += weight
                    for *_, v in segments_of(words, own[fold]):
                        got[k, 1, round(v, 2)] += weight
            yield pd.DataFrame([(*k, n) for k, n in got.items()], columns=["setting", "kind", "value", "n"])

    sums = sample.mapInPandas(spread, "setting int, kind int, value double, n long").groupBy("setting", "kind", "value").agg(F.sum("n").alias("n")).collect()
    models = []
    for k, setting in enumerate(SETTINGS):
        model = Model(_listed(candidates, seen, setting))
        part = lambda kind: sorted((r.value, r.n / WHOLE) for r in sums if (r.setting, r.kind) == (k, kind))  # noqa: B023, E731
        words = sum(n for _, n in part(2))
        hits = dict(part(0)) | {round(v, 2): dict(part(0)).get(round(v, 2), 0.0) for v in model.listed.values()}
        if hits and words:
            model.rate = _chance_rate(sorted(hits), np.array([hits[v] for v in sorted(hits)]), words)
            least = min(hits)
            model.k = (sum(n for v, n in part(1) if v >= least) + 0.5) / words * math.exp(model.rate * least)
        models.append(model)
    chances = [(m.rate, m.k) for m in models]

    def measure(batches):
        scores = [[_Scores(f) for f in s] for s in lists]
        for b in batches:
            out = []
            for y, fold, weight, text in zip(b["y"], b["fold"], b["weight"], b["text"]):
                words = words_of(text)
                for k, own in enumerate(scores):
                    found = [s for *_, s in segments_of(words, own[fold])]
                    out.append((k, y, weight, evidence(Model({}, *chances[k]), len(words), found)))
            yield pd.DataFrame(out, columns=["setting", "y", "weight", "x"])

    got = sorted(map(tuple, sample.mapInPandas(measure, "setting int, y int, weight long, x double").collect()))
    losses = []
    for k, model in enumerate(models):
        _, y, weight, x = np.array([r for r in got if r[0] == k], float).T
        model.slope, model.offset = _logistic(x, y, weight / WHOLE)
        z = np.clip(model.slope * x + model.offset, -30, 30)
        losses.append(float((weight / WHOLE * (np.log1p(np.exp(z)) - y * z)).sum()))
    return models[int(np.argmin(losses))]


def passages(docs: DataFrame, model: Model, most_by_chance: float = REPORT_E) -> DataFrame:
    """doc_id, first_word, end_word, score, expected: each significant passage of each whole text.

    Texts without one (empty and null ones too) give no rows. Rows that repeat give theirs again."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.Series:
        m = shared.value
        scores, out = _Scores(m.listed), []
        for t in texts:
            words = words_of(t)
            rows = [(a, b, s, expected(m, len(words), s)) for a, b, s in segments_of(words, scores)]
            out.append([dict(zip(("first_word", "end_word", "score", "expected"), r)) for r in rows if r[3] < most_by_chance])
        return pd.Series(out)

    return docs.select("doc_id", F.inline(find("text")))


def scored(docs: DataFrame, model: Model, most_by_chance: float = REPORT_E) -> DataFrame:
    """doc_id, score (0..1), predicted (score >= 0.5) and n_passages (the significant ones) of each row.

    Texts without evidence (null and empty ones too) score the curve's value at 0. Repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_passages long")
    def score(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        scores, out = _Scores(m.listed), []
        for t in texts:
            words = words_of(t)
            n, found = len(words), [s for *_, s in segments_of(words, scores)]
            z = m.slope * evidence(m, n, found) + m.offset
            out.append((1 / (1 + math.exp(-min(max(z, -30), 30))), sum(expected(m, n, s) < most_by_chance for s in found)))
        return pd.DataFrame(out, columns=["score", "n_passages"]).astype({"score": "float64", "n_passages": "int64"})

    d = docs.select("doc_id", score("text").alias("_s")).select("doc_id", "_s.*")
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_sample(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "n_passages")
