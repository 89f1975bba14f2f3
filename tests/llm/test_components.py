"""Connected components and joins with hot keys, against plain Python, on both of their ways."""

import random

import pytest

from memspark.llm import common, components


def plain(links):
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        low[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(low)}


@pytest.mark.parametrize("least", [10, 50_000])
def test_components_match_plain_ones(spark, monkeypatch, least):
    monkeypatch.setattr(common, "HOT_LEAST", least)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    monkeypatch.setattr(components, "HOT_LEAST", least)
    rng = random.Random(1)
    links = [(1, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)]
    got = components.connected_components(spark.createDataFrame([*links, (7, 7), (None, 1)], "a long, b long")).collect()
    want = plain([x for x in links if x[0] != x[1]])
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_joins_are_plain_joins(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 90 + [2] * 40 + [3, 4, None, None])], "k long, i long")
    dim = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "k long, v string")
    assert sorted(map(str, common.join_hot(rows, dim, "k", how).collect())) == sorted(map(str, rows.join(dim, "k", how).collect()))
