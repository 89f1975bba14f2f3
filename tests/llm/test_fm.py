"""The factorisation machine against plain sums, and its held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from memspark.llm import fm


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = fm.Model(0.3, rng.normal(size=fm.STRUCTURE + fm.BUCKETS), rng.normal(size=(fm.STRUCTURE + fm.BUCKETS, fm.RANK)))
    at, x = fm.features("One two two three # 4 FOUR!\nfive five")
    plain = 0.3 + sum(model.w[i] * z for i, z in zip(at, x))
    plain += sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(fm.raw_score(model, at, x) - plain) < 1e-9
    assert len(set(at.tolist())) == len(at)


def test_held_out_accuracy_and_bounds(spark):
    sf = "/root/testdata/sf0.01"
    out = fm.op8_quality_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    rows = out.collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and more words of a text {i}") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (fm.fit_sample(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, other))
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()


def test_nulls_long_texts_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "", "s"), (2, "a " * 50000, None), (3, " \n", "s")], "doc_id long, text string, score string")
    model = fm.fit_sample(docs, none)
    rows = fm.classified(docs, model).collect()
    assert len(rows) == 5 and all(abs(r.score - 0.5) < 1e-9 for r in rows)
    assert fm.keep_good(docs, model).columns == docs.columns
    assert fm.classified(docs.filter(F.lit(False)), model).count() == 0
    mixed = spark.createDataFrame([(None, 1), (1, None), (2, 7), (2, 1), (3, 0)], "doc_id long, quality int")
    assert fm.fit_sample(docs, mixed, held=None).w.shape == model.w.shape


def test_digits_of_a_whole_text_count_once():
    for n in (10, 1500, 2500, 3999, 4000, 9001):
        text = ("7" * 4 + " " + "a" * 5) * (n // 10) + "b" * (n % 10)
        at, x = fm.features(text)
        share = dict(zip(at.tolist(), x.tolist()))[13] / 2
        assert abs(share - sum(c.isdigit() for c in text) / len(text)) < 1e-12


def test_fitting_and_scoring_see_the_same_words_of_long_texts(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(900)) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(fm, "fit", lambda rows, y: seen.extend(rows))
    fm.fit_sample(docs, labels, held=None)
    assert len(seen) == 6
    for (at, x), text in zip(seen, texts):
        want_at, want_x = fm.features(text)
        assert (at == want_at).all() and np.abs(x - want_x).max() < 1e-6


def test_words_and_lines_part_at_ascii_blanks_only():
    a, b = (dict(zip(*(v.tolist() for v in fm.features(t)))) for t in ("AB\u2003CD x\u2028y z", "ABxCD xxy z"))
    assert a[1] == b[1] and a[12] == b[12]
