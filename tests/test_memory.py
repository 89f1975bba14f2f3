"""Operators against plain Python: folds over long keys, caps, medians, blends, restores, redaction, blocks of vectors."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import scoring as sc
from memspark.operators import aggregates as ag
from memspark.operators import caps
from memspark.operators import graph as gr
from memspark.operators import lifecycle as lc
from memspark.operators import privacy as pv
from memspark.operators import retrieval as rt
from memspark.operators import stores as st
from memspark.operators import upkeep as up
from memspark.operators import windows as wn


def test_fading_threshold_of_a_very_long_key(spark):
    rng = random.Random(1)
    rows = [("a", i, rng.random()) for i in range(20_000)] + [("b", i, 0.5) for i in range(3)]
    got = wn.fading_threshold(spark.createDataFrame(rows, "u string, i long, s double"), ["u"], ["i"], "s").orderBy("u", "i").collect()
    want, t = [], {}
    for u, _, s in rows:
        t.setdefault(u, 0.4)
        want.append(t[u])
        t[u] = 0.9 * t[u] + 0.1 * min(max(s, 0.1), 0.6)
    assert max(abs(r.threshold - w) for r, w in zip(got, want)) < 1e-9
    assert all(r.passes == (r.s >= r.threshold) for r in got)


def one_pass(rows, most):
    """rows: {(layer, a, b): weight}"""
    used, want = {}, set()
    for (layer, a, b), _ in sorted(rows.items(), key=lambda r: (-r[1], r[0])):
        if used.get((layer, a), 0) < most and used.get((layer, b), 0) < most:
            used[layer, a], used[layer, b] = used.get((layer, a), 0) + 1, used.get((layer, b), 0) + 1
            want.add((layer, a, b))
    return want


@pytest.mark.parametrize("limit", [1000, 60, 15])
def test_degree_caps_are_those_of_one_pass(spark, limit):
    rng = random.Random(2)
    rows = {(rng.choice("xy"), f"n{rng.randrange(12)}", f"m{rng.randrange(12)}"): rng.choice([0.1, 0.2, 0.3]) for _ in range(200)}
    rows |= {("z", f"c{i:02}", f"c{j:02}"): 0.4 for i in range(14) for j in range(i + 1, 14)}
    schema = "layer string, source_id string, target_id string, weight double"
    got = caps.capped(spark.createDataFrame([(*k, w) for k, w in rows.items()], schema), 3, limit).collect()
    assert {(r.layer, r.source_id, r.target_id) for r in got} == one_pass(rows, 3)
    assert caps.capped(spark.createDataFrame([], schema), 3).count() == 0


@pytest.mark.parametrize(("chunk", "most"), [(1000, 3), (7, 3), (1, 2), (20, 12)])
def test_caps_of_groups_are_those_of_all_their_pairs(spark, chunk, most):
    rng = random.Random(chunk)
    held = {(rng.choice("xy"), f"n{i:02}"): rng.sample("abcdef", rng.randrange(0, 4)) for i in range(60)}
    pairs = {(la, a, b): 0.4 for (la, a), x in held.items() for (lb, b), y in held.items() if la == lb and a < b and set(x) & set(y)}
    members = spark.createDataFrame([(*k, g) for k, gs in held.items() for g in [*gs, None, *gs[:1]]], "layer string, node_id string, group string")
    got = [tuple(r) for r in caps.capped_groups(members, most, chunk).collect()]
    assert len(got) == len(set(got))
    assert set(got) == one_pass(pairs, most)


def test_a_group_of_very_many_nodes_forms_no_pairs(spark):
    began = time.monotonic()
    members = spark.range(5000).select(F.lit("user").alias("layer"), F.format_string("n%05d", "id").alias("node_id"), F.lit("e").alias("group"))
    got = [(r.source_id, r.target_id) for r in caps.capped_groups(members, 12, 2000).collect()]
    assert time.monotonic() - began < 60
    # In the order of names blocks of 13 nodes fill each other.
    assert set(got) == {(f"n{a:05}", f"n{b:05}") for a in range(5000) for b in range(a + 1, min(5000, a - a % 13 + 13))}


def test_topic_overlap_equals_all_pairs(spark):
    rng = random.Random(6)
    for common in (0, 3):
        texts = {f"n{i}": [f"word{rng.randrange(25)}" for _ in range(rng.randrange(1, 9))] + [f"often{k}" for k in range(common)] for i in range(60)}
        texts["alias"] = ["petit", "word1", "word2"]
        texts["named"] = ["small", "word1", "word2"]
        syn = {"small": ["petit"]}
        words = {k: {"petit" if w == "small" else w for w in v} for k, v in texts.items()}
        likes = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a in words for b in words if a < b and len(words[a] & words[b]) >= 2}
        middle = statistics.median(likes.values())
        tau = max(0.3, middle - 1.5 * statistics.median(abs(v - middle) for v in likes.values()))
        nodes = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()] + [("none", None)], "node_id string, content string")
        got = {(r.a, r.b): r.weight for r in gr.topic_overlap(nodes, syn).collect()}
        assert got == pytest.approx({k: v for k, v in likes.items() if v >= tau})
        assert got


def test_shared_entities_are_capped(spark, sf_dir):
    from memspark.plans import stewards

    got = stewards.capped_entities(spark, sf_dir).collect()
    degree = {}
    for r in got:
        for n in (r.source_id, r.target_id):
            degree[n] = degree.get(n, 0) + 1
    assert got and max(degree.values()) <= 12


def test_median_is_exact(spark):
    rng = random.Random(3)
    for n in (1, 2, 999, 1000):
        v = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
        assert ag.median(df, F.col("v")) == statistics.median(v)
    assert ag.mad_threshold(spark.createDataFrame([], "v double"), "v").first().tau is None


def test_blends_boosts_and_confidence(spark):
    a = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.2)], "query_id string, id long, score double")
    b = spark.createDataFrame([("q", 1, 0.9)], "query_id string, id long, score double")
    imp = spark.createDataFrame([(1, 1.0)], "id long, importance double")
    assert {r.id: round(r.score, 6) for r in rt.hybrid([a, b], imp, "id").collect()} == {1: 0.93, 2: 0.14}
    q = spark.createDataFrame([("How to deploy the server?",), ("nothing",)], "q string")
    assert [round(r[0], 6) for r in q.select(rt.kind_boost(F.col("q"), ["how to", "deploy", "x"])).collect()] == [0.2, 0.0]
    hits = spark.createDataFrame([("q", "red green blue", "a red thing"), ("q", "red green blue", "Blue!")], "query_id string, query string, content string")
    assert round(rt.confidence(hits).first().confidence, 6) == round(2 / 3, 6)


def test_postings_of_asked_terms_equal_the_index(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "C b été"), (3, None), (4, "")], "id long, t string")
    q = spark.createDataFrame([("q", "a été")], "query_id string, query string")
    some, stats = rt.asked_postings(docs, "id", q, "t")
    every, stats2 = rt.postings(docs, "id", "t")
    assert stats.first() == stats2.first()
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in every.where(F.col("term").isin("a", "été")).collect()}


def test_restore_leaves_equal_nulls_alone(spark):
    rows = lambda *v: spark.createDataFrame([("u", f"k{i}", x) for i, x in enumerate(v)], "user_id string, key string, value string")
    plan = lc.restore(rows(None, "a", "b"), rows(None, "a", None, "new"))
    assert {r.key for r in plan["write"].collect()} == {"k2", "k3"} and plan["delete"].count() == 0


def test_credentials_and_tags_are_redacted(spark):
    texts = ["xoxb-" + "1" * 24, "AIza" + "b" * 35, "sk_live_" + "c" * 24, "1234567890:" + "d" * 35, "bearer " + "e" * 30, "<private>x</secret> y</private> z", "<secret>s</secret>", "plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pv.strip_secrets(F.col("t"))).collect()]
    assert got == ["[REDACTED]"] * 5 + ["[REDACTED] z", "[REDACTED]", "plain"]


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(rt, "QUERY_BLOCK", 3)
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 7)
    got = rt.cosine_search(df, df.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id"), 4).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 60, 7):
        s = np.round(unit @ unit[q], 6)
        s[q] = -9
        want = sorted(range(60), key=lambda i: (-s[i], i))[:4]
        assert {r.vec_id for r in got if r.query_id == q} == set(want)


def test_all_alike_bit_patterns_are_found(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (0, 0, 3, 9, 14)] + [0, 0]
    rows = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    got = {(r.a, r.b) for r in gr.bridges_by_likeness(spark.createDataFrame(rows, "vec_id long, bits long"), 0.6, block=16).collect()}
    alike = lambda x, y: (x | y) and bin(x & y).count("1") / bin(x | y).count("1") >= 0.6
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if alike(values[i], values[j])}


def test_words_of_bits_of_long_vectors(spark):
    v = [1.0 if i % 3 == 0 else -1.0 for i in range(384)]
    (r,) = spark.createDataFrame([(v,)], "v array<double>").select(sc.binary_words(F.col("v"), F.array_repeat(F.lit(0.0), 384)).alias("w")).collect()
    assert len(r.w) == 6
    assert "".join(format(w % 2**64, "064b") for w in r.w) == "".join("1" if x > 0 else "0" for x in v)


def test_tool_triplets_and_saves(spark):
    pairs = spark.createDataFrame([("c", "grep", "needle", "found it", False)], "call string, tool string, argument string, result string, is_error boolean")
    assert {(r.source_id, r.target_id) for r in up.tool_triplets(pairs).collect()} == {("query:needle", "action:grep:needle"), ("action:grep:needle", "outcome:ok:found it")}


def test_exports_come_back_and_are_counted(spark, tmp_path):
    facts = spark.createDataFrame([("u", "a", "1", "goal"), ("u", "b", None, "fact"), ("v", "a", "2", "goal")], "user_id string, key string, value string, memory_kind string")
    st.export_parts(facts, f"{tmp_path}/x", F.col("memory_kind"), "kind")
    new, counts = st.import_new(spark, f"{tmp_path}/x", "user_id string, key string, value string", facts.limit(0).unionByName(facts.where("user_id = 'v'")), ["user_id", "key"])
    assert {(r.user_id, r.key, r.value) for r in new.collect()} == {("u", "a", "1"), ("u", "b", None)}
    assert tuple(counts.first()) == (3, 2, 1)
    left = st.archive_and_prune(facts, f"{tmp_path}/y", F.col("memory_kind") == "goal")
    assert left.count() == 1 and spark.read.json(f"{tmp_path}/y").count() == 2
    assert st.delete_branch(st.create_branch(facts.withColumn("layer", F.lit("l")), "l", "u", "b"), "l", "b").count() == 3


def test_hash_vectors_have_unit_length(spark):
    (r,) = spark.createDataFrame([("Some Text",)], "t string").select(st.hash_embedding("t").alias("v")).collect()
    assert len(r.v) == 384 and abs(sum(x * x for x in r.v) - 1) < 1e-6 and r.v == st.hash_vector("some text")
