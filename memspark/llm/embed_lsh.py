"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Vectors of unit length are projected on random directions and quantised; a few
quantised projections together name a bucket, in each of several tables. Vectors
that meet in a bucket are compared exactly. Depth and number of the tables follow
from the number of vectors and the recall wanted at the threshold itself. Exact
copies are one class from the start. Large buckets are cut into blocks, and every
pair of blocks is compared by a task of its own, as a matrix product; what leaves
a task is a number of links for each vector and a spanning forest, not the pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, read
from .components import connected_components

COSINE, RECALL, SEED = 0.98, 0.9999, 23
#: Width of a quantisation step in distances at the threshold.
WIDTH = 5.0
#: Vectors of a block of a large bucket.
BLOCK = 256


def collision(ratio: float) -> float:
    """Chance that a p-stable hash joins two points whose distance is 1/ratio steps."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a bucket, tables) for n vectors: unrelated vectors meet about once in a table, and a pair
    at the threshold meets in some table with the chance `recall`."""
    near, far = collision(WIDTH), collision(WIDTH * math.sqrt(2 - 2 * cosine) / math.sqrt(2))
    depth = max(3, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - near**depth))


def buckets_of(unit: np.ndarray, depth: int, tables: int, cosine: float = COSINE, seed: int = SEED) -> np.ndarray:
    """The bucket of each unit vector in each table, as a 64-bit number."""
    rng = np.random.default_rng([seed, depth, unit.shape[1]])
    step = WIDTH * math.sqrt(2 - 2 * cosine)
    directions, shifts = rng.normal(size=(unit.shape[1], tables * depth)), rng.random(tables * depth)
    cells = np.floor(unit @ directions / step + shifts).astype(np.int64).reshape(len(unit), tables, depth)
    mix = np.random.default_rng([seed, 1]).integers(1, 1 << 62, depth, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (cells * mix).sum(2)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (root, member) that connect what the pairs a, b connect among 0..n-1."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    member = np.flatnonzero(low != np.arange(n))
    return list(zip(low[member].tolist(), member.tolist()))


def _block_pair(table: pa.Table, cosine: float, ddl: pa.Schema) -> pa.Table:
    """Links found in one pair of blocks of a bucket and in no earlier table."""
    t, first, second = table.column("t")[0].as_py(), table.column("bx")[0].as_py(), table.column("by")[0].as_py()
    unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(table.num_rows, -1)
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int64).reshape(table.num_rows, -1)[:, :t]
    ids, size, block = (np.array(table.column(c).to_pylist(), np.int64) for c in ("cid", "m", "block"))
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    links = np.zeros(len(ids), np.int64)
    a, b = np.nonzero(unit[left] @ unit[right].T >= cosine)
    a, b = left[a], right[b]
    if first == second:
        a, b = a[a < b], b[a < b]
    for part in range(0, len(a), 20_000):
        i, j = a[part : part + 20_000], b[part : part + 20_000]
        new = ~(codes[i] == codes[j]).any(1)
        np.add.at(links, i[new], size[j[new]])
        np.add.at(links, j[new], size[i[new]])
    root = np.arange(len(ids))
    for low, member in forest(len(ids), a, b):
        root[member] = low
    out = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
    return pa.Table.from_arrays([pa.array(ids[out]), pa.array(links[out]), pa.array(ids[root[out]])], schema=ddl)


def _name(label: str, e: str) -> Column:
    return F.xxhash64(label, e)


def _classes(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors of a label are a class, named by a hash of both. Where others have the same hash, all but the least
    take another. Returns v with the names it ends with, and the classes."""
    for again in range(3):
        found = v.filter("copies is not null").groupBy(F.col("copies").alias("cid")).agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.min(F.struct("label", "e")).alias("low"), F.max(F.struct("label", "e")).alias("high"))
        found = cut(found.withColumn("clash", F.col("low") != F.col("high")).select("cid", "least", "m", "low.*", "clash"))
        clash = found.filter("clash").select("cid", F.col("label").alias("_label"), F.col("e").alias("_e"))
        if clash.isEmpty():
            return v, found.drop("clash")
        other = F.col("_e").isNotNull() & ((F.col("label") != F.col("_label")) | (F.col("e") != F.col("_e")))
        met = v.join(clash, F.col("copies") == F.col("cid"), "left")
        v = cut(met.withColumn("copies", F.when(other, F.xxhash64(F.lit(again), "label", "e")).otherwise(F.col("copies"))).select(*v.columns))
    raise RuntimeError("hashes of vectors still clash")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vectors: vec_id long, label, embedding (an array of floats or doubles).

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id and kept. Rows with
    equal labels whose cosine is at least `cosine` link; a null label, and a vector that is null, empty, zero or
    holds null or non-finite components, links with nothing. Vectors of different lengths don't link. Equal rows
    are rows of their own, and their copies count as links. A null vec_id links, but names no component unless
    all its links are null, too. An empty table gives no rows."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    fine = F.coalesce(F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0), F.lit(False))
    v = cut(v.select("vec_id", F.when(fine, _name("label", "e")).alias("copies"), F.when(fine, F.col("label")).alias("label"), F.when(fine, F.col("e")).alias("e")))
    v, classes = _classes(v)
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    depth, tables = tables_for(largest, cosine, recall)

    def hashed(batches):
        for b in batches:
            if not len(b):
                continue
            done = []
            for _, part in b.groupby(b["e"].map(len)):
                x = np.vstack(part["e"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                codes = buckets_of(unit, depth, tables, cosine)
                done.append(pd.DataFrame({"cid": part["cid"].to_numpy(), "m": part["m"].to_numpy(), "label": part["label"].to_numpy(), "dims": unit.shape[1], "unit": [u.tobytes() for u in unit], "codes": [c.tobytes() for c in codes], "buckets": list(codes)}))
            yield pd.concat(done)

    coded = cut(classes.select("cid", "m", "label", "e").mapInPandas(hashed, "cid long, m long, label string, dims int, unit binary, codes binary, buckets array<long>"))
    key = ["label", "dims", "t", "code"]
    met = coded.select("cid", "label", "dims", F.posexplode("buckets").alias("t", "code"))
    full = met.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    met = met.join(full, key).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("bx"), F.greatest("block", o).alias("by")))
    met = met.select("cid", *key, "block", F.inline(pairs)).join(coded.select("cid", "m", "unit", "codes"), "cid")
    shape = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    found = cut(met.groupBy(*key, "bx", "by").applyInArrow(lambda t: _block_pair(t, cosine, shape), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    least = joined.join(classes, "cid").groupBy("component").agg(F.min("least").alias("low"))
    named = joined.join(least, "component").select("cid", "low")
    done = classes.select("cid", "m", "least").join(links, "cid", "left").join(named, "cid", "left")
    done = cut(done.select(F.col("cid").alias("copies"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "least").alias("component_id")))
    out = join_hot(v.select("vec_id", "copies"), done, "copies", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), d AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0)::bigint AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.x LEFT JOIN d ON e.vec_id = d.x
"""
