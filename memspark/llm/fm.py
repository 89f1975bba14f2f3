"""Quality classifier: a factorisation machine over hashed words, structure and length of a text.

Score = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, the last sum taken in linear
time as half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2. The model is fitted with AdaGrad on
a bounded sample of labelled rows and has a fixed size, so it goes to the tasks whole."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, read, words_of

#: Buckets of hashed words, rank of the interactions, labelled rows fitted at most, passes over them.
BUCKETS, RANK, FIT_ROWS, EPOCHS = 1 << 14, 8, 6000, 12
_MARKS = b"#*$%&|<>!"
STRUCTURE = 16


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray


def structure(words: list[bytes], text: str) -> list[float]:
    """Shape of a whole text (words and lines as between ASCII blanks and line feeds): how long, how varied, how much of it is marks, capitals, digits and repeats. All in 0..1 or near."""
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (STRUCTURE - 1)
    raw, counts = text.encode(), Counter(words)
    size = len(raw)
    marks = [raw.count(bytes([m])) for m in _MARKS]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(bytes.isupper, raw.split()))
    most = counts.most_common(1)[0][1]
    return [
        0.0,
        min(1.0, np.log1p(n) / 10),
        min(1.0, sum(map(len, words)) / n / 20),
        len(counts) / n,
        most / n if n >= 5 else 0.0,
        min(1.0, sum(marks[:5]) / n),
        min(1.0, marks[5] / n),
        min(1.0, (marks[6] + marks[7]) / n),
        min(1.0, marks[8] / n),
        upper / n,
        sum(w[-1:] in b".,;:?!" for w in words) / n,
        len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 200),
        (size - len(raw.translate(None, b"0123456789"))) / size,
        sum(w == z for w, z in zip(words, words[1:])) / n,
        1.0 if n < 10 else 0.0,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text: hashed words (logarithmic counts, unit length) after the structure."""
    words = words_of(text)
    shape = np.array(structure(words, text or ""))
    counts = Counter(words).items()
    crc = zlib.crc32
    at = np.fromiter((crc(w) % BUCKETS for w, _ in counts), np.int64, len(counts))
    seen = np.bincount(at, np.fromiter((c for _, c in counts), np.float64, len(counts)), BUCKETS) if len(counts) else np.zeros(BUCKETS)
    at = np.flatnonzero(seen)
    x = np.log1p(seen[at])
    x = x / max(1e-12, float(np.sqrt((x * x).sum())))
    used = np.flatnonzero(shape)
    return np.concatenate([used, at + STRUCTURE]), np.concatenate([shape[used] * 2, x])


def raw_score(model: Model, at: np.ndarray, x: np.ndarray) -> float:
    v = model.v[at] * x[:, None]
    s = v.sum(0)
    return float(model.bias + model.w[at] @ x + 0.5 * (s @ s - (v * v).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 11, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """AdaGrad over shuffled rows, one at a time. Without both classes the bias alone is fitted."""
    rng, size = np.random.default_rng(seed), STRUCTURE + BUCKETS
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    good = sum(labels)
    if not rows or good in (0, len(rows)):
        return Model(float(np.log((good + 0.5) / (len(rows) - good + 0.5))), model.w, model.v * 0)
    g0, gw, gv = 1e-2, np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            (at, x), y = rows[i], labels[i]
            v = model.v[at]
            s = x @ v
            z = model.bias + model.w[at] @ x + 0.5 * (s @ s - ((v * x[:, None]) ** 2).sum())
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            dw = d * x + decay * model.w[at]
            dv = d * x[:, None] * (s - v * x[:, None]) + decay * v
            g0 += d * d
            model.bias -= rate * d / np.sqrt(g0)
            gw[at] += dw * dw
            model.w[at] -= rate * dw / np.sqrt(gw[at])
            gv[at] += dv * dv
            model.v[at] -= rate * dv / np.sqrt(gv[at])
    return model


def fit_sample(docs: DataFrame, labels: DataFrame, held: tuple[int, int] | None = (3, 1), rows: int = FIT_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, quality). Fits on rows labelled 0 or 1 that aren't held out.

    At most `rows` of them: those with the smallest hash of doc_id, so the sample doesn't depend on
    how the table is dealt out. Of rows that share an id the least text counts; null ids and labels don't."""
    ids = labels.filter("doc_id is not null and quality in (0, 1)")
    if held:
        ids = ids.filter(~held_out(F.col("doc_id"), *held))
    ids = ids.select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def encode(batches):
        for b in batches:
            made = [features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "at": [a.astype(np.uint16).tobytes() for a, _ in made], "x": [x.astype(np.float32).tobytes() for _, x in made]})

    kept = sample.select(F.col("doc_id").cast("string"), "y", "text").mapInPandas(encode, "doc_id string, y int, at binary, x binary")
    got = sorted((r.doc_id, r.y, r.at, r.x) for r in kept.collect())
    return fit([(np.frombuffer(a, np.uint16), np.frombuffer(x, np.float32).astype(np.float64)) for _, _, a, x in got], [y for _, y, _, _ in got])


def scorer(spark: SparkSession, model: Model):
    """A column function: the probability of label 1 of a whole text, in 0..1 (null counts as empty)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([1 / (1 + np.exp(-np.clip(raw_score(m, *features(t)), -30, 30))) for t in texts], dtype="float64")

    return score


def classified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted; doc_id and text are needed, and any column named like those two is replaced.

    A null or empty text is scored like any text without words. Rows that repeat get equal scores."""
    d = docs.withColumn("score", scorer(docs.sparkSession, model)("text"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs predicted 1, with all their columns and no others."""
    return docs.filter(scorer(docs.sparkSession, model)("text") >= 0.5)


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_sample(docs, read(spark, sf_dir, "labels"))
    return classified(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
