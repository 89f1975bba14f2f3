"""Members that share groups, in small groups, in blocks of large ones and for members of very many groups."""

import random
from itertools import combinations

import pyarrow as pa
import pytest

from memspark.operators import joins as jn


def _items(seed: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    rows = {(g, f"m{m}") for m in range(60) for g in r.sample(range(12), r.randint(1, 4))}
    return sorted(rows | {(g, "m999") for g in range(12)} | {(g, "m7") for g in range(12)} | {(100 + m, f"m{m}") for m in range(60)})


@pytest.mark.parametrize(("small", "block", "carried"), [(64, 2048, 128), (3, 2048, 128), (3, 5, 128), (3, 5, 6), (64, 5, 6)])
@pytest.mark.parametrize("least", [1, 2])
def test_pairs_are_those_of_a_plain_count(spark, monkeypatch, small, block, carried, least):
    for k, v in {"SMALL": small, "BLOCK": block, "CARRIED": carried}.items():
        monkeypatch.setattr(jn, k, v)
    rows = _items(3)
    groups: dict[str, set[int]] = {}
    for g, m in rows:
        groups.setdefault(m, set()).add(g)
    new = {m: int(m[1:]) % 3 == 0 for m in groups}
    df = spark.createDataFrame([(g, m, new[m]) for g, m in rows] + [(None, "m1", True), (3, None, True)], "g long, m string, new boolean")
    want = {(a, b, n) for a, b in combinations(sorted(groups), 2) if (n := len(groups[a] & groups[b])) >= least}
    assert sorted(map(tuple, jn.pairs_sharing(df, "g", "m", least).collect())) == sorted(want)
    got = jn.pairs_sharing(df, "g", "m", least, "new").collect()
    assert sorted(map(tuple, got)) == sorted(p for p in want if new[p[0]] or new[p[1]])


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(jn, "SMALL", 3)
    df = spark.createDataFrame(_items(5), "g long, m string")
    plan = jn.pairs_sharing(df, "g", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a" not in plan


def test_pairs_are_dealt_to_tasks_by_their_number_and_carry_batches(spark, monkeypatch):
    """Few rows make many pairs: they met in as few tasks as the rows fill. Names are written once for many pairs."""
    monkeypatch.setattr(jn, "PAIRS_OF_TASK", 500)
    monkeypatch.setattr(jn, "BLOCK", 60)
    monkeypatch.setattr(jn, "EMITTED", 64)
    rows = [(g, f"m{m:03}", m % 5 - 2) for m in range(150) for g in (0, 100 + m // 10, 200 + m % 3)]
    found = jn.pairs_sharing(spark.createDataFrame(rows, "g long, m string, batch int"), "g", "m", 1, "batch", weigh=lambda n: n * 10)
    groups = {m: {g for g, x, _ in rows if x == m} for _, m, _ in rows}
    of = {m: b for _, m, b in rows}
    want = {(a, b, 10 * len(groups[a] & groups[b]), max(of[a], of[b])) for a, b in combinations(sorted(of), 2) if max(of[a], of[b]) >= 0}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert found.rdd.getNumPartitions() >= 150 * 150 / 2 / 500


def test_block_of_a_group_gives_its_names_once_for_many_pairs():
    names = [f"m{i:04}" for i in range(300)]
    t = pa.table({"_m": names, "_new": pa.array([0] * 300, pa.int32()), "_of": pa.array([[7]] * 300, pa.list_(pa.int32())), "_c": pa.array([0] * 300, pa.int32()), "_h": pa.array([7] * 300, pa.int32()), "_i": pa.array([0] * 300, pa.int32()), "_j": pa.array([0] * 300, pa.int32())})
    out = jn._block_pairs(t, 1)
    assert sum(len(x) for x in out["at"].to_pylist()) == 300 * 299 // 2 and len(out) == 1 and out["names"][0].as_py() == names
