"""Rows that meet in blocks: evidence, outcomes, communities and joint retrievals against plain versions, with few rows to a block or task."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from memspark.operators import graph as gr
from memspark.operators import joins as jn
from memspark.operators import miners as mn
from memspark.operators import upkeep as up


def shuffled(df):
    """Rows that the plan's shuffles wrote, the most of one."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plan.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            plan.append(p.plan())
        else:
            if p.nodeName() == "Exchange":
                most = max(most, p.metrics().apply("shuffleRecordsWritten").value())
            plan += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_evidence_equals_all_pairs_and_shuffles_no_pair(spark, monkeypatch):
    monkeypatch.setattr(up, "EVIDENCE_BLOCK", 50)
    rnd, names = random.Random(3), [f"w{i}" for i in range(12)]
    some = lambda k: rnd.sample(names, rnd.randint(0, k))
    facts = [(rnd.choice(["u", "v", None]), i, some(4)) for i in range(150)] + [("z", 200, ["w1"]), ("u", 201, None)]
    rows = [(rnd.choice(["u", "v", None]), i, some(5)) for i in range(200)]
    f, j = spark.createDataFrame(facts, "user_id string, entry_id long, words array<string>"), spark.createDataFrame(rows, "user_id string, id long, words array<string>")
    for least in (1, 2, 3):
        want = {}
        for u, i, w in facts:
            n = [len({*(w or [])} & {*x}) for v, _, x in rows if u is not None and v == u]
            want[i] = "exists" if any(k and k >= len(w or []) for k in n) else "probable" if any(k >= least for k in n) else "unknown"
        found = up.evidence(f, j, ["user_id"], least)
        assert {r.entry_id: r.verdict for r in found.collect()} == want
    # 7000 pairs share a user; what is shuffled are rows, each as often as the other side has blocks.
    assert shuffled(found) <= 200 * 4


def test_outcomes_equal_all_pairs_and_shuffle_no_pair(spark, monkeypatch):
    monkeypatch.setattr(mn, "LED_BLOCK", 64)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.sample(["alpha", "beta", "gamma", "that", "delta"], rnd.randint(0, 3))), rnd.randint(0, 4_000_000)) for i in range(300)]
    rows += [(5, "alpha that", 3_000_000), (301, None, 5), (302, "alpha", None)]
    want = set()
    for a, x, s in rows:
        for b, y, t in rows:
            if None not in (x, y, s, t) and 300 <= t - s <= 30 * 86_400 and re.search("that", y) and {*x.split()} & {*y.split()}:
                want.add((a, b))
    df = spark.createDataFrame(rows, "node_id long, content string, created_at long")
    found = mn.led_to(df, "that").select("source_id", "target_id")
    got = found.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    once = mn.led_to(df.where("created_at <> 3000000"), "that")
    assert shuffled(once) <= 303 * 6 < len(want)


def test_communities_and_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randint(0, 40)}", f"n{rnd.randint(0, 40)}", rnd.randint(1, 9) / 10) for _ in range(200)]
    weight, label = defaultdict(dict), {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            weight[x][y] = max(w, weight[x].get(y, 0))
    for x, near in weight.items():
        near[x], label[x] = max(near.values()), x
    df = spark.createDataFrame(edges, "source_id string, target_id string, weight double")
    monkeypatch.setattr(jn.in_tasks, "__kwdefaults__", {"each": 50})
    for rounds in (0, 1, 3):
        now = dict(label)
        for _ in range(rounds):
            votes = {x: defaultdict(float) for x in weight}
            for x, near in weight.items():
                for y, w in near.items():
                    votes[x][now[y]] += w
            now = {x: min(v, key=lambda c: (-round(v[c], 6), c)) for x, v in votes.items()}
        found = mn.communities(df, rounds)
        assert {r.node: r.community for r in found.collect()} == now
    assert jn.in_tasks(df, 400, "source_id").rdd.getNumPartitions() == 8
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_topic_overlap_writes_candidates_alone(spark, monkeypatch):
    rnd = random.Random(7)
    # All share a word that is rarer than their others; a few are alike.
    texts = {f"n{i:03}": {"shared", *rnd.sample([f"word{k}" for k in range(400)], 20)} for i in range(300)}
    for i in range(0, 40, 2):
        texts[f"n{i:03}"] = {*sorted(texts[f"n{i + 1:03}"])[:14], "other", "shared"}
    seen, own = [], gr._met

    def met(rows, floor):
        found = [own(rows, floor, block) for block in (2048, 50)]
        a, b = ({tuple(r) for r in f.collect()} for f in found)
        assert a == b
        seen.append(a)
        return found[1]

    monkeypatch.setattr(gr, "_met", met)
    monkeypatch.setattr(gr, "_pairs_at_least", lambda *_: 1 << 60)
    nodes = spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in texts.items()], "node_id string, content string")
    got = {(r.a, r.b): round(r.weight, 9) for r in gr.topic_overlap(nodes, {}).collect()}
    # "other" is a stop word or not, so sets are those that the operator sees.
    sets = {r.node_id: set(r.w) for r in nodes.select("node_id", gr.distil.canonical_tokens(F.col("content"), {}).alias("w")).collect()}
    likes = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in likes.items() if v >= 0.3} and len(got) >= 20
    assert set(got) <= seen[0] and len(seen[0]) < 1000 < 300 * 299 // 2


def test_topic_overlap_keeps_words_and_sketches_in_columns(spark, monkeypatch):
    """Checkpoints hold whole rows, uncompressed: words and sketches of all nodes took most of the room."""
    seen, own = [], gr.cut
    monkeypatch.setattr(gr, "cut", lambda df: seen.append(set(df.columns)) or own(df))
    nodes = spark.createDataFrame([(f"n{i}", f"alpha{i % 9} beta{i % 5} gamma delta") for i in range(40)], "node_id string, content string")
    assert gr.topic_overlap(nodes, {}).count() > 0
    assert seen and not any({"words", "sketch"} & columns for columns in seen)
