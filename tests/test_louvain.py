"""Communities by modularity against a plain one-by-one pass, and their edge cases."""

import random
from collections import defaultdict

import pytest

from memspark.operators import louvain as lv

SCHEMA = "source_id string, target_id string, weight double"


def quality(edges, label):
    total, inside, degree = 0.0, 0.0, defaultdict(float)
    for a, b, w in edges:
        total += 2 * w
        inside += 2 * w * (label[a] == label[b])
        degree[label[a]] += w
        degree[label[b]] += w
    return inside / total - sum(v * v for v in degree.values()) / total**2


def plain(edges):
    """Nodes one by one, then communities as nodes, until nothing gains."""
    found = {n: n for e in edges for n in e[:2]}
    while True:
        near = defaultdict(lambda: defaultdict(float))
        for a, b, w in edges:
            near[a][b] += w
            near[b][a] += w
        label, k = {n: n for n in near}, {n: sum(v.values()) for n, v in near.items()}
        size, total, moved, any_move = dict(k), sum(k.values()), True, False
        while moved:
            moved = False
            for n in sorted(near):
                size[label[n]] -= k[n]
                seen = defaultdict(float)
                seen[label[n]] += 0
                for o, w in near[n].items():
                    if o != n:
                        seen[label[o]] += w
                best = max(seen, key=lambda c: (round(seen[c] - k[n] * size[c] / total, 9), c == label[n]))
                moved |= best != label[n]
                any_move |= best != label[n]
                label[n] = best
                size[best] += k[n]
        found = {n: label[c] for n, c in found.items()}
        edges = [(label[a], label[b], w) for a, b, w in edges]
        if not any_move:
            return found


def test_modularity_is_that_of_a_plain_pass(spark):
    rng = random.Random(4)
    edges = [(f"n{a}", f"n{b}", rng.choice([0.3, 0.6, 1.0])) for _ in range(70) for a, b in [(rng.randrange(15), rng.randrange(15))] if a % 3 == b % 3 or rng.random() < 0.12]
    df = spark.createDataFrame(edges, SCHEMA)
    found = lv.louvain(df).cache()
    label = {r.node: r.community for r in found.collect()}
    assert set(label) == {n for e in edges for n in e[:2]}
    assert all(label[c] == c for c in label.values())
    mine, want = quality(edges, label), quality(edges, plain(edges))
    assert lv.modularity(df, found) == pytest.approx(mine)
    assert mine >= want - 0.02 * abs(want)
    again = {r.node: r.community for r in lv.louvain(df.repartition(7)).collect()}
    assert again == label


def test_loops_parts_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "d", 1.0), ("e", "e", 2.0), (None, "a", 1.0), ("a", "c", None), ("b", "d", -1.0)], SCHEMA)
    assert {r.node: r.community for r in lv.louvain(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}
    assert lv.louvain(df.limit(0)).collect() == []
    assert lv.modularity(df.limit(0), lv.louvain(df.limit(0))) == 0.0
