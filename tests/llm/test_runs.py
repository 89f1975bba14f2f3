"""Periodic runs against the definition, extensions against comparing word by word, and the whole query against a plain version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.llm import runs


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def plain(w, least):
    """Maximal stretches of each period by a linear pass; those whose smallest period it is."""
    found = set()
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, 3 * p) and smallest_period(w[i : i + length]) == p:
                found.add((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 24))
def test_runs_of_few_symbols(w, least):
    assert list(map(tuple, runs.runs_of(np.array(w, np.int64), least).tolist())) == plain(w, least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_blocks(blocks):
    w = [x for block, times in blocks for x in block * times]
    assert list(map(tuple, runs.runs_of(np.array(w, np.int64)).tolist())) == plain(w, 24)


def test_extensions():
    rng = np.random.default_rng(3)
    for n, kinds in ((2, 1), (50, 1), (300, 2), (1000, 30)):
        w = rng.integers(0, kinds, n)
        x, y = rng.integers(0, n, (2, 500))
        x, y = x[x != y], y[x != y]
        want = [next((k for k in range(n) if max(a, b) + k >= n or w[a + k] != w[b + k])) for a, b in zip(x, y)]
        assert runs.Extensions(w)(x, y).tolist() == want


def test_chunks_of_the_grid_change_nothing(monkeypatch):
    w = np.array((list(range(40)) * 5 + [7] * 90 + [1, 2] * 30) * 3)
    whole = runs.runs_of(w).tolist()
    monkeypatch.setattr(runs, "CHUNK", 50)
    assert runs.runs_of(w).tolist() == whole == list(map(list, plain(w.tolist(), 24)))


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = plain(w, 24)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    top = max(found, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2])) if found else (None,) * 3
    milli = 1000 * top[1] // top[2] if found else None
    told = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *top, milli, digest(told), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = runs.op12_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted((plain_row(*d) for d in docs), key=lambda r: r[0])
    assert sum(r[1] > 0 for r in got) > 5


def test_edge_cases(spark, tmp_path):
    planted_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [None, "", " \t\n", "one", "Word word " * 12, "word " * 24, "word " * 23, "a b c " * 8, "\u00e4\u00a0x " * 30, "a\x0bb\x0ca\r\nb " * 10, " ".join(f"w{i}" for i in range(500)), ("x " * 30 + "y ") * 40, "z " * 800 + "end"]
    rows = [(i, t) for t in texts for i in (1, 1, planted_id, None)]
    spark.createDataFrame([(*r, "s", "r") for r in rows], "doc_id long, text string, source string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_row(*r)) for r in rows)


def test_a_very_long_text():
    w = np.r_[np.zeros(200_000, np.int64), [1], np.tile(np.arange(5, 5000), 20)]
    assert runs.runs_of(w).tolist() == [[0, 200_000, 1], [200_001, 99_900, 4995]]


def test_empty_table(spark):
    none = spark.createDataFrame([], "text string")
    assert none.select(runs.periodic_runs(F.col("text")).alias("r")).select("r.*").collect() == []


@pytest.mark.parametrize(("runs_in", "want"), [([], None), ([(5, 30, 10), (2, 60, 20), (2, 30, 10)], (2, 30, 10)), ([(0, 25, 8), (9, 50, 15)], (9, 50, 15))])
def test_best_run_and_its_ties(spark, runs_in, want):
    df = spark.createDataFrame([(runs_in,)], "r array<struct<start: long, length: long, period: long>>")
    got = df.select(runs.best("r").alias("b")).first().b
    assert (got and tuple(got)) == want
