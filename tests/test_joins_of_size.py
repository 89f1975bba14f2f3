"""Pairs and medians whose groups are large: the same results, with few rows joined."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from memspark.operators import aggregates as ag
from memspark.operators import graph as gr
from memspark.operators import miners as mn
from memspark.operators import upkeep as up




def test_related_facts_of_values_that_many_nodes_have(spark):
    links = spark.createDataFrame([("p1", "s1"), ("p2", "s2")], "page string, node_id string")
    nodes = spark.createDataFrame([(f"n{i}", "same" if i % 3 else "other") for i in range(600)] + [("s1", "x"), ("s2", "y")], "node_id string, content string")
    edges = spark.createDataFrame([("s1" if i < 300 else "s2", f"n{i}") for i in range(600)], "source_id string, target_id string")
    facts = spark.createDataFrame([(i, "same") for i in range(50)] + [(49, "other"), (49, "other"), (None, "same"), (None, "other"), (60, None), (61, "lone")], "entry_id long, value string")
    out = up.related_facts(links, nodes, edges, facts)
    want = {(p, e) for p in ("p1", "p2") for e in [*range(50), None]}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    # A page's values meet the facts once: no more than a page and fact each, not one for each of its nodes.
    assert max(r for r in _join_rows(spark, out)) < 5000


def _join_rows(spark, df):
    """Rows that each join of a plan has put out, once it ran."""
    found = []

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "Join" in name and plan.metrics().contains("numOutputRows"):
            found.append(plan.metrics().apply("numOutputRows").value())
        if name.endswith("QueryStage"):
            walk(plan.plan())
        kids = plan.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_sessions_near_nodes_of_one_and_several_times(spark):
    rng = random.Random(3)
    nodes = [(f"n{rng.randrange(40)}" if i % 3 else f"m{i}", rng.randrange(9000)) for i in range(120)] + [(None, 50), ("n1", None)]
    spans = [(rng.randrange(8), rng.randrange(9000)) for _ in range(150)] + [(None, 60), (3, None)]
    want = {(n, s) for n, t in nodes for s, u in spans if t is not None and u is not None and abs(t - u) <= 30}
    out = up.near_sessions(spark.createDataFrame(nodes, "node_id string, created_at long"), spark.createDataFrame(spans, "session_id long, ts long"), 30)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    # Every time of a session was joined by itself before.
    crowd = up.near_sessions(spark.createDataFrame([(f"x{i}", 1000) for i in range(50)], "node_id string, created_at long"), spark.createDataFrame([(1, 1000 + k) for k in range(25)], "session_id long, ts long"), 30)
    assert max(_join_rows(spark, crowd)) <= 50


def test_conflicts_join_few_facts_of_a_word(spark):
    saves = spark.createDataFrame([("b", i, f"large bolts {i % 7}") for i in range(40)], "brand string, save_id long, content string")
    facts = spark.createDataFrame([("b", i, f"large bolt {i % 3}" if i % 2 else "small ring") for i in range(400)], "brand string, entry_id long, content string")
    out = mn.conflicts(saves, facts, ["brand"])
    assert sorted((r.save_id, r.entry_id) for r in out.collect()) == [(i, 1) for i in range(40)]
    assert max(_join_rows(spark, out)) <= 40 * 2 * 5


def test_twins_are_compared_once_for_all_rows_of_their_texts(spark):
    names = ["red bolt", "red bolts", "blue gear", "hot rod"]
    rows = [(i % 2, i, names[i // 2 % 4]) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, id long, content string")
    of = {(a, b): v for a, b, v in df.sparkSession.createDataFrame([(a, b) for a in names for b in names], "a string, b string").select("a", "b", mn.similarity(F.col("a"), F.col("b"))).collect()}
    want = {(a, b): of[x, y] for k, a, x in rows for h, b, y in rows if k == h and a < b and of[x, y] > 0.3}
    got = mn.twins(df, ["k"]).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("kind", ["equal", "spread", "two", "none"])
def test_median_takes_few_values_to_the_driver(spark, monkeypatch, kind):
    monkeypatch.setattr(ag, "MIDDLE", 20)
    rng = random.Random(5)
    values = {"equal": [1.0] * 3000 + [0.5, 2.0], "spread": [rng.gauss(0, 5) for _ in range(3001)] + [1e300, -1e300], "two": [1.0, 2.0], "none": []}[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "w double")
    assert ag.median(df, F.col("w")) == (statistics.median(values) if values else None)


def test_neighbours_look_up_the_ends_of_their_own_edges_alone(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(500)] + [("n1", "gone"), ("gone", "n400"), ("n2", "n2")]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    members = spark.createDataFrame([(f"n{i}",) for i in range(501)], "node_id string")
    out = gr.neighbours(edges, members, spark.createDataFrame([("n1",), ("n1",), ("gone",)], "node string"), 2)
    assert sorted((r.origin, r.node, r.depth) for r in out.collect()) == [("n1", "n0", 1), ("n1", "n2", 1), ("n1", "n3", 2)]
    assert max(_join_rows(spark, out)) < 100


def test_related_facts_meet_as_lists(spark, monkeypatch):
    """Pages and facts of a value are joined as lists: rows of joins were pairs of them before. A page without a name counts."""
    monkeypatch.setattr(up, "PARTS", 2)
    monkeypatch.setattr(up, "FACTS", 10)
    links = spark.createDataFrame([(f"p{i}" if i else None, f"s{i}") for i in range(100)], "page string, node_id string")
    nodes = spark.createDataFrame([("n0", "same"), ("n1", "same"), ("n2", "unknown")], "node_id string, content string")
    edges = spark.createDataFrame([(f"s{i}", f"n{k}") for i in range(100) for k in range(3)], "source_id string, target_id string")
    facts = spark.createDataFrame([(i, "same") for i in range(90)] + [(i, v) for i in (200, 201) for v in ("same", "other")], "entry_id long, value string")
    out = up.related_facts(links, nodes, edges, facts)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == {(f"p{i}" if i else None, e) for i in range(100) for e in [*range(90), 200, 201]} and len(got) == 100 * 92
    assert max(_join_rows(spark, out)) < 3000
