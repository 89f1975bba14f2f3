"""Searches whose vectors and queries fill several blocks, against all pairs."""

import numpy as np
import pytest

from memspark.operators import retrieval as rt


@pytest.fixture
def vectors(spark, monkeypatch):
    monkeypatch.setattr(rt, "QUERY_BLOCK", 5)
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 20)
    # Small partitions would be merged, and blocks meet in one task whatever their hashes are.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    x = np.random.default_rng(7).normal(size=(120, 8)).round(3)
    yield x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cosine_search_over_several_blocks(vectors):
    x, df = vectors
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.round(unit @ unit.T, 6)
    want = {(q, v) for q in range(0, 120, 3) for v in sorted(set(range(120)) - {q}, key=lambda v, q=q: (-near[q, v], v))[:4]}
    got = rt.cosine_search(df, df.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id"), 4).collect()
    assert len(got) == len(want)
    assert {(r.query_id, r.vec_id) for r in got} == want


def test_binary_search_over_several_blocks(spark, vectors):
    bits = [int(b) for b in np.random.default_rng(8).integers(0, 2**62, 120)]
    df = spark.createDataFrame(list(enumerate(bits)), "vec_id long, bits long")
    want = {(q, v, (bits[q] ^ bits[v]).bit_count()) for q in range(0, 120, 3) for v in sorted(range(120), key=lambda v, q=q: ((bits[q] ^ bits[v]).bit_count(), v))[:4]}
    got = rt.binary_search(df, df.where("vec_id % 3 = 0").withColumnsRenamed({"vec_id": "query_id", "bits": "qbits"}), 4).collect()
    assert len(got) == len(want)
    assert {(r.query_id, r.vec_id, r.distance) for r in got} == want


def test_each_query_finds_its_nearest_over_several_blocks(vectors):
    """What fact_cover averages: one row for each query, none is lost between blocks."""
    x, df = vectors
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.round(unit @ unit.T, 6)
    got = rt.cosine_search(df.where("vec_id % 10 >= 5"), df.where("vec_id % 10 < 5").withColumnRenamed("vec_id", "query_id"), 1).collect()
    others = [i for i in range(120) if i % 10 >= 5]
    assert {r.query_id: r.score for r in got} == {q: near[q, others].max() for q in range(120) if q % 10 < 5}
    assert len(got) == 60
