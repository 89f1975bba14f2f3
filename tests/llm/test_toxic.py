"""Maximal segments against brute force; held-out accuracy on the labelled table."""

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.llm import toxic


def plain_segments(s, base=0):
    """Ruzzo and Tompa's definition: the best segment, then those left and right of it, each for itself."""
    best = None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            total = sum(s[i:j])
            if total > 0 and (best is None or (total, i - j) > (best[2], best[0] - best[1])):
                best = (i, j, total)
    if best is None:
        return []
    i, j, total = best
    return plain_segments(s[:i], base) + [(base + i, base + j, total)] + plain_segments(s[j:], base + j)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).filter(bool), max_size=14))
def test_maximal_segments_match_the_definition(s):
    mine = toxic.maximal_segments(s)
    assert sorted(t for *_, t in mine) == sorted(t for *_, t in plain_segments(s))
    for a, b, total in mine:
        assert sum(s[a:b]) == total > 0


def test_linear_on_long_input():
    assert toxic.maximal_segments([1, -2] * 200_000)[-1] == (399_998, 399_999, 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxic.op10_toxic_segments(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    bad, good = ([r for r in rows if r.held_out and r.toxic == y] for y in (1, 0))
    caught, wrong = sum(r.predicted for r in bad), sum(r.predicted for r in good)
    print(f"toxic held out: {caught} of {len(bad)} caught; clean: {wrong} of {len(good)} called toxic")
    assert caught >= 0.9 * len(bad) and wrong <= 0.01 * len(good)


def test_planted_passage_is_found_where_it_lies(spark):
    rng = random.Random(6)
    some = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    clean = [(i, some(60), 0) for i in range(100)]
    bad = [(100 + i, some(30) + " vile nasty, Vile! " + some(20 + i), 1) for i in range(40)]
    both = spark.createDataFrame([(*r, 9.0) for r in clean + bad], "doc_id long, text string, toxic int, score double")
    model = toxic.fit_sample(both, both.select("doc_id", "toxic"))
    found = toxic.passages(both, model).collect()
    assert {r.doc_id for r in found} == {b[0] for b in bad}
    spans = {d: [(r.first_word, r.end_word) for r in found if r.doc_id == d] for d, *_ in bad}
    assert all(any(a <= 30 and b >= 33 for a, b in s) for s in spans.values()), spans
    assert sum(s == [(30, 33)] for s in spans.values()) > 20
    assert {r.doc_id for r in toxic.scored(both, model).collect() if r.predicted} == {b[0] for b in bad}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"x", b"y", b"z"]), max_size=40))
def test_segments_of_a_text_are_those_of_its_scores(words):
    scores = toxic._Scores({b"=a": 1.0, b"=b": 2.5})
    want = toxic.maximal_segments([scores[w] for w in words])
    assert [(a, b, round(s, 6)) for a, b, s in toxic.segments_of(words, scores)] == [(a, b, round(s, 6)) for a, b, s in want]


def test_more_segments_are_more_evidence():
    m = toxic.Model({}, 1.0, 1e-3)
    one, two, five = (toxic.evidence(m, 1000, [6.0] * n) for n in (1, 2, 5))
    assert 0 < one < two < five <= 60
    assert toxic.evidence(m, 1000, []) == 0 and toxic.evidence(m, 10**9, [6.0]) == 0
    assert toxic.evidence(m, 1000, [6.0, 6.0, 0.1]) == two


def test_near_copies_weigh_as_one_text(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(i, base + " end" * (i % 2), 1) for i in range(40)] + [(100 + i, f"another text number {i} of its own {i * i}", i % 2) for i in range(30)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    kept = toxic._sample(both, both.select("doc_id", "toxic"), None, 1000).collect()
    copies = [r for r in kept if r.text.startswith("word0")]
    assert len(kept) == 70 and len({r.fold for r in copies}) == 1
    assert abs(sum(r.weight for r in copies) / toxic.WHOLE - 1) < 1e-3


def test_nulls_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a " * 60000), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxic.fit_sample(docs, none)
    rows = toxic.scored(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert toxic.passages(docs, model).count() == 0
    assert toxic.scored(docs.filter(F.lit(False)), model).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 5), (3, 1)], "doc_id long, toxic int")
    assert toxic.fit_sample(docs, odd, held=None).listed == {}
