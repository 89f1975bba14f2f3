"""Hierarchical budgets against a plain water level, prefixes against plain sums."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from memspark.llm import mixing


def level(nodes, budget):
    """nodes: key -> (cap, weight). Fills in rounds until the budget or all nodes run out."""
    given, left, live = dict.fromkeys(nodes, 0.0), float(min(budget, sum(c for c, w in nodes.values() if w > 0))), {k for k, (c, w) in nodes.items() if w > 0}
    while left > 1e-9 and live:
        part = left / sum(nodes[k][1] for k in live)
        dry = {k for k in live if nodes[k][0] - given[k] <= part * nodes[k][1] + 1e-9}
        for k in dry or live:
            add = min(nodes[k][0] - given[k], part * nodes[k][1])
            given[k] += add
            left -= add
        live -= dry or live
    return {k: int(v + 1e-6) for k, v in given.items()}


def plain(rows, dw, lw, share, epochs, seed):
    tokens = defaultdict(int)
    for _, t, d, lang, s in rows:
        tokens[d, lang, s] += len((t or "").split())
    caps = {k: v * epochs if dw.get(k[0], 1) > 0 and lw.get(k[1], 1) > 0 else 0 for k, v in tokens.items()}
    up = lambda n: {k: sum(v for x, v in caps.items() if x[:n] == k) for k in {x[:n] for x in caps}}
    out = {}
    for d, b in level({k: (c, dw.get(k[0], 1)) for k, c in up(1).items()}, sum(tokens.values()) * share // 1000).items():
        for m, b2 in level({k: (c, lw.get(k[1], 1)) for k, c in up(2).items() if k[:1] == d}, b).items():
            live = dw.get(m[0], 1) > 0 and lw.get(m[1], 1) > 0
            out |= level({k: (c, int(live)) for k, c in caps.items() if k[:2] == m}, b2)
    copies = {}
    for leaf, b in out.items():
        full = b // tokens[leaf] if tokens[leaf] else 0
        rest, so_far = b - full * tokens[leaf], 0
        key = lambda r: (hashlib.md5(":".join([str(seed), str(full + 1)] + [str(r[0])] * (r[0] is not None)).encode()).hexdigest(), r[0])  # noqa: B023, E731
        for r in sorted((r for r in rows if tuple(r[2:]) == leaf), key=key):
            copies[r[0]] = full + (so_far < rest)
            so_far += len((r[1] or "").split())
    return copies


@pytest.mark.parametrize(("share", "epochs"), [(400, 1), (900, 2), (5000, 3), (0, 1)])
def test_matches_plain_budgets(spark, share, epochs):
    rng = random.Random(share)
    rows = [(i, rng.choice([None, "", "a b c " * rng.randrange(9)]), rng.choice("ppppq"), rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["s", "s", "s", "t", None])) for i in range(300)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, d string, lang string, source string, copies int")
    dw, lw = {"p": 3, "q": 1}, {"en": 2, "de": 5, "xx": 0}
    mix = mixing.Mix(F.col("d"), F.when(F.col("d") == "p", 3).otherwise(1), F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 5).when(F.col("lang") == "xx", 0).otherwise(1), F.lit(1), share, epochs, 9)
    got = {r.doc_id: r.copies for r in mixing.mixed(docs, mix, {"doc_id": F.col("doc_id")}).collect()}
    assert got == plain(rows, dw, lw, share, epochs, 9)
    took = mixing.take(docs, mix)
    assert took.columns == docs.columns and took.count() == sum(got.values())


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [(i, "w " * 10, "p", "en", "s" if i < 10 else "t") for i in range(40)] + [(100 + i, "w " * 10, "q", "en", "u") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, lang string, source string")
    mix = mixing.Mix(F.col("d"), F.lit(1), F.lit(1), F.lit(1), 500, 1)
    got = mixing.mixed(docs, mix, {"d": F.col("d"), "source": F.col("source")}).filter("copies > 0").groupBy("d", "source").count().collect()
    assert {(r.d, r.source): r["count"] for r in got} == {("p", "s"): 10, ("p", "t"): 10, ("q", "u"): 20}


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    mix = mixing.production_mix()
    assert mixing.take(spark.createDataFrame([], schema), mix).count() == 0
    docs = spark.createDataFrame([(None, "a b", None, None)] * 4, schema)
    assert sorted(r.copies for r in mixing.mixed(docs, mix, {"doc_id": F.col("doc_id")}).collect()) == [0, 0, 1, 1]


def test_main_path_runs_no_python(spark, sf_dir):
    plan = mixing.op7_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
