"""Embedding near-duplicates against all pairs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import embed_lsh as el

SCHEMA = "vec_id long, label int, embedding array<float>, n_links string"


def plain(rows, cosine):
    def unit(label, e):
        if label is None or not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            return None
        x = np.array(e, np.float32).astype(np.float64)
        return x / np.sqrt(x @ x)

    units = [unit(r[1], r[2]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, u in enumerate(units):
        for j in range(i):
            v = units[j]
            if u is not None and v is not None and rows[i][1] == rows[j][1] and len(u) == len(v) and u @ v >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)]) for i, r in enumerate(rows))


def test_all_pairs_are_found(spark, monkeypatch):
    monkeypatch.setattr(el, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(6, 24))
    for i in range(150):
        x = base[i % 6] + rng.normal(size=24) * rng.choice([0.01, 0.1, 0.14, 0.2])
        rows.append((1000 - i, int(i % 3 == 0), (x * rng.choice([1, 5])).tolist()))
    rows += [(2000 + i, 1, rows[0][2]) for i in range(40)] + [(i, 1, rng.normal(size=24).tolist()) for i in range(200)]
    rows += [(3000, None, rows[0][2]), (3001, 1, None), (3002, 1, []), (3003, 1, [0.0] * 24), (3004, 1, [None] + [1.0] * 23), (3005, 1, [float("nan")] * 24), (3006, 1, [float("inf")] * 24), (3007, 1, rows[0][2][:5]), (3008, 1, rows[0][2][:5]), (7000, 1, [1e-30] * 24), (7001, 1, [1e30] * 24)]
    got = el.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("n", [10, 5000, 10**6])
def test_recall_holds_at_the_threshold(n):
    depth, tables = el.tables_for(n)
    rng, dims, hits = np.random.default_rng(n), 64, 0
    for _ in range(60):
        a = rng.normal(size=dims)
        a /= np.linalg.norm(a)
        b = rng.normal(size=dims)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        codes = el.buckets_of(np.vstack([a, 0.98 * a + math.sqrt(1 - 0.98**2) * b]), depth, tables)
        hits += (codes[0] == codes[1]).any()
    assert hits >= 59


def test_forest_connects_what_pairs_connect():
    assert sorted(el.forest(6, np.array([4, 1, 2]), np.array([5, 4, 3]))) == [(1, 4), (1, 5), (2, 3)]
    assert el.forest(3, np.array([], int), np.array([], int)) == []


def test_empty_table_and_repeated_rows(spark):
    assert el.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = el.near_duplicates(spark.createDataFrame([(5, 1, [1.0, 0.0], "")] * 3 + [(None, 1, [1.0, 0.0], "")], SCHEMA)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == {(5, 3, 5, True): 3, (None, 3, 5, False): 1}


def test_vectors_whose_hashes_clash_stay_apart(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, f"l{i % 2}", x.tolist()) for i, x in enumerate(np.repeat(rng.normal(size=(20, 6)), 2, 0))]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    want = sorted(map(tuple, el.near_duplicates(df).collect()))
    monkeypatch.setattr(el, "_name", lambda label, e: F.pmod(F.xxhash64(label, e), F.lit(5)))
    assert sorted(map(tuple, el.near_duplicates(df).collect())) == want
