"""Communities whose labels settle, against plain rounds, with graphs that settle late."""

import random
from collections import defaultdict

import pytest

from memspark.operators import miners as mn


def plain(edges, rounds=None):
    """Labels after so many rounds, or settled ones, and how many rounds that took."""
    near = defaultdict(dict)
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near[x][y] = max(w, near[x].get(y, 0))
    for x, of in near.items():
        of[x] = max(of.values())
    seen = [{x: x for x in near}]
    while rounds is None or len(seen) <= rounds:
        votes = {x: defaultdict(int) for x in near}
        for x, of in near.items():
            for y, w in of.items():
                votes[x][seen[-1][y]] += round(w * 1e6)
        seen.append({x: min(v, key=lambda c: (-v[c], c)) for x, v in votes.items()})
        if rounds is None and (seen[-1] == seen[-2] or len(seen) > 2 and seen[-1] == seen[-3]):
            return {x: min(seen[-1][x], seen[-2][x]) for x in near}, len(seen) - 1
    return seen[-1], rounds


def chain(n):
    return [(f"n{i:02}", f"n{i + 1:02}", 1.0 - i / 100) for i in range(n)]


def ring(seed):
    rnd = random.Random(seed)
    return [(f"a{rnd.randint(0, 12):02}", f"b{rnd.randint(0, 9):02}", rnd.choice([0.1, 0.2, 0.3])) for _ in range(60)]


# All of one side are tied to all of the other, one of them to itself, too.
SIDES = [(a, b, 1.0) for a in ("a0", "a1", "a2") for b in ("b0", "b1", "b2")] + [("a0", "a0", 0.1)]


@pytest.mark.parametrize("edges", [chain(12), *map(ring, range(4)), SIDES, [("x", "x", 1.0)], []])
@pytest.mark.parametrize("links", [1_000_000, 7])
def test_labels_settle_as_in_plain_rounds(spark, monkeypatch, edges, links):
    monkeypatch.setattr(mn, "LINKS", links)
    df = spark.createDataFrame([*edges, (None, "z", 1.0)], "source_id string, target_id string, weight double")
    assert {r.node: r.community for r in mn.communities(df).collect()} == plain(edges)[0]
    assert {r.node: r.community for r in mn.communities(df, 2).collect()} == plain(edges, 2)[0]


def test_one_round_is_not_the_whole_job(spark):
    settled, rounds = plain(chain(12))
    assert rounds > 4 and settled != plain(chain(12), 1)[0]


def test_rounds_shuffle_no_links(spark):
    """Links are dealt once: what a round shuffles is nothing, whatever the graph."""
    df = spark.createDataFrame(ring(9), "source_id string, target_id string, weight double")
    plan = mn.communities(df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "votes" not in plan
