"""The audit against a plain version that applies all orders, and the edge cases of the docstring."""

import re
from itertools import permutations

from memspark.llm import filter_audit as fa


def plain(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Applies each order filter by filter."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and first[text] < i]
        fails.append({z for z, b in zip("ABCDE", bad) if b})
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = {}
    for part in {d[2] or "" for d in docs}:
        rows = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        by_filter = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, z in enumerate(order, 1):
                removed, kept = [r for r in left if z in r[1]], [r for r in left if z not in r[1]]
                by_filter[z] += len(removed)
                redundant = sum(z in f for _, f in rows) - len(removed)
                out[part, order, step] = [len(kept), len(removed), redundant, sum(f == {z} for _, f in rows), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(by_filter[order[step - 1]])
    return out


def check(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, part string, mask int")
    lab = spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in fa.audit(d, lab).collect()}
    assert got == plain(docs, labels)


WORDS = " ".join(f"w{i}" for i in range(250))


def test_edge_cases_equal_the_plain_version(spark):
    docs = [
        (1, WORDS, "de"), (2, WORDS, "de"), (3, WORDS, None), (3, WORDS, None), (0, WORDS + "#", ""), (None, WORDS, "de"), (None, WORDS, "de"), (None, None, "fr"), (None, "", "fr"),
        (4, None, "fr"), (5, "", "de"), (6, " \n\t", "fr"), (7, "same " * 300, "de"), (8, "Same same " * 150, "de"), (9, WORDS.upper(), "de"), (10, "a\x0bb\x0cc\u00a0d ABC", "de"),
        (7, WORDS + " other", "de"), (11, "x " * 100 + " ".join(f"y{i}" for i in range(99)), "it"), (12, "x " * 101 + " ".join(f"y{i}" for i in range(100)), "it"), (13, "A" * 3 + "\u00e4" * 97, "it"),
        (14, "\U0001f600" * 97 + "AAA", "it"), (15, "\U0001f600" * 96 + "AAA", "it"), (16, WORDS + " | & *", "it"), (17, "long " * 50000 + WORDS, "it"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (5, 1, 1)]
    check(spark, docs, labels)


def test_whole_table_equals_the_plain_version(spark, sf_dir):
    d, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    check(spark, [(r.doc_id, r.text, r.lang) for r in d.collect()], [(r.doc_id, r.quality, r.toxic) for r in lab.collect()])


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(d, lab).collect() == []
    check(spark, [(1, "word", "de")], [])


def test_words_are_not_shuffled(spark):
    d = spark.createDataFrame([(1, "a b", 2)], "k1 long, text string, k2 long")
    plan = fa.word_totals(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
