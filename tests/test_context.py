"""Packing of context against plain loops, and its edge cases."""

import random

from memspark.operators import context as cx

SCHEMA = "user_id string, place int, score double, content string"


def cost(text):
    return len(text) // 4


def key(text):
    return " ".join(text.split())[:80]


def plain_weights(blocks, budget):
    """blocks: {source: [content, ...]}"""
    floors = {s: int(budget * w) for s, w in cx.WEIGHTS.items()}
    used, seen, out = dict.fromkeys(cx.WEIGHTS, 0), set(), []

    def add(source, text, cap):
        if text.strip() and key(text) not in seen and used[source] + cost(text.strip()) <= cap:
            seen.add(key(text))
            used[source] += cost(text.strip())
            out.append((source, text.strip()))

    for s, cap in floors.items():
        for text in blocks.get(s, []):
            if used[s] >= cap:
                break
            add(s, text, cap)
    for s in sorted(cx.WEIGHTS, key=lambda s: -cx.WEIGHTS[s]):
        left, ceiling = budget - sum(used.values()), max(2 * floors[s], 40)
        if left <= 0 or used[s] >= ceiling:
            continue
        cap = min(used[s] + left, ceiling)
        for text in blocks.get(s, []):
            if used[s] >= cap:
                break
            add(s, text, cap)
    return out


def test_floors_and_ceilings_equal_a_plain_walk(spark):
    rng = random.Random(5)
    text = lambda: rng.choice(["", "  ", "ab", "same  block", "same block "]) if rng.random() < 0.2 else "x" * rng.randrange(1, 300) + str(rng.randrange(40))
    data = {u: {s: [text() for _ in range(rng.randrange(0, 9))] for s in cx.WEIGHTS if rng.random() < 0.8} for u in "abcdefgh"}
    sources = {s: spark.createDataFrame([(u, i, 0.5, t) for u in data for i, t in enumerate(data[u].get(s, []))] + [("a", 99, 0.5, None)], SCHEMA) for s in cx.WEIGHTS}
    for budget in (0, 100, 400):
        got = {}
        for r in sorted(cx.pack_by_weights(sources, ["user_id"], budget).collect(), key=lambda r: (r.user_id, r.place)):
            got.setdefault(r.user_id, []).append((r.source, r.content))
            assert r.tokens == cost(r.content)
        assert got == {u: want for u in data if (want := plain_weights(data[u], budget))}


def test_order_keys_and_what_a_block_stands_for(spark):
    first = spark.createDataFrame([("a", 1, 1.0, "one; two", ["one thing", "two"])], SCHEMA + ", also array<string>")
    then = spark.createDataFrame([("a", 1, 0.5, "two"), ("a", 2, 0.5, "y" * 80), ("a", 3, 0.5, "three"), ("b", 1, 0.1, "two")], SCHEMA)
    got = sorted((r.user_id, r.place, r.source, r.content) for r in cx.pack_in_order({"m": first, "s": then}, ["user_id"], 12).collect())
    assert got == [("a", 1, "m", "one; two"), ("a", 2, "s", "three"), ("b", 1, "s", "two")]
    assert cx.pack_in_order({"m": first.limit(0)}, ["user_id"], 10).collect() == []
    assert [r.content for r in cx.pack_in_order({"s": then}, ["user_id"], 100, most=1).collect()] == ["two", "two"]


def test_blank_queries_get_marks_and_the_day_alone(spark):
    block = lambda t: spark.createDataFrame([(u, 1, 0.5, f"{t} of {u}") for u in "ab"], SCHEMA)
    axes = {a: block(a) for a in ("day", "markers", "session", "triggered")}
    users = spark.createDataFrame([("a", " "), ("b", "tea")], "user_id string, query string")
    got = {}
    for r in sorted(cx.recall_protocol(axes, users, ["user_id"]).collect(), key=lambda r: r.place):
        got.setdefault(r.user_id, []).append(r.source)
    assert got == {"a": ["markers", "day"], "b": ["markers", "session", "triggered", "day"]}
