"""Patience alignment against longest common subsequences, scans against planted passages."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from memspark.llm import licenses as lic

LINES = {"apache-2.0-line", "cc-by-nc-4.0-line", "gpl-3.0-line", "mit-line"}


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=20), st.lists(st.sampled_from("abcdefgh"), max_size=12))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = lic.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == longest(a, b)


@given(st.lists(st.integers(0, 50), max_size=30))
def test_increasing_is_longest(x):
    got = [x[i] for i in lic.increasing(x)]
    best = longest(x, sorted(set(x)))
    assert got == sorted(set(got)) and len(got) == best


def test_planted_templates_are_found_once_each(spark):
    rng = random.Random(9)
    fill = lambda n: " ".join(rng.choice(["the", "of", "a", "is", "to"]) if rng.random() < 0.4 else f"w{rng.randrange(500)}" for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(lic.TEMPLATES.items()):
        words = text.split()
        if len(words) > 20:
            for _ in range(len(words) // 12):
                words[rng.randrange(len(words))] = "changed"
        n = rng.randrange(3, 400)
        rows.append((i, f"{fill(n)}\n{' '.join(words)}\n{fill(50)}"))
        want.add((i, name, n))
    rows += [(100, fill(2000)), (101, None), (102, ""), (103, "license mit the under"), (104, f"{fill(9)} {lic.TEMPLATES['mit-line']} {fill(30)} {lic.TEMPLATES['mit-line']}")]
    got = lic.passages(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, coverage double")).collect()
    found = {(r.doc_id, r.license, r.first_word) for r in got}
    assert {(i, n) for i, n, _ in want} <= {(i, n) for i, n, _ in found}
    assert all(any(r.doc_id == i and r.license == n and abs(r.first_word - at) <= 3 for r in got) for i, n, at in want)
    assert not [r for r in got if r.doc_id in (100, 101, 102)]
    assert len([r for r in got if r.doc_id == 104 and r.license == "mit-line"]) == 2
    assert all(r.coverage >= lic.COVERAGE for r in got)


def test_lines_in_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(i, n) for i, t in texts.items() for n in LINES if lic.TEMPLATES[n] in t}
    got = {(r.doc_id, r.license) for r in lic.passages(docs).collect()}
    assert want and want <= got
    words = {n: lic.words(lic.TEMPLATES[n]) for n in lic.TEMPLATES}
    assert all(longest(words[n], lic.words(texts[i])) >= lic.COVERAGE * len(words[n]) for i, n in got)
    assert len(got - want) <= 0.02 * len(got)


def test_adjacent_copies_after_words_of_the_template_are_all_found():
    rng, scanner, missed, all_ = random.Random(3), lic.Scanner(lic.TEMPLATES), 0, 0
    for name, text in lic.TEMPLATES.items():
        own = lic.words(text)
        for copies in (1, 2, 3, 5):
            for before in range(12):
                lead = " ".join(rng.choice(own).decode() for _ in range(before))
                got = [r for r in scanner.scan(f"{lead} " + " ".join([text] * copies)) if r[0] == name]
                missed, all_ = missed + max(0, copies - len(got)), all_ + copies
    assert missed <= 0.01 * all_


def test_edited_copies_amid_words_of_their_own_are_found():
    """Against the definition: a passage is there if the longest common subsequence covers 0.8 of the template."""
    rng, scanner, missed, all_ = random.Random(4), lic.Scanner(lic.TEMPLATES), 0, 0
    for _ in range(60):
        for name, text in lic.TEMPLATES.items():
            w = text.split()
            own = w + ["the", "of", "to"]
            for _ in range(rng.randrange(len(w) // 9 + 1)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["other"], [w[k], "extra"], [rng.choice(own)]])
            around = [rng.choice(own) for _ in range(rng.randrange(60))]
            full = around[:30] + w + around[30:]
            if longest(lic.words(text), lic.words(" ".join(w))) >= 0.8 * len(lic.words(text)):
                all_ += 1
                missed += not any(r[0] == name and r[2] < 30 + len(w) and r[3] > min(30, len(around)) for r in scanner.scan(" ".join(full)))
    assert all_ > 400 and missed <= 0.01 * all_, (missed, all_)


def test_repeated_rows_null_ids_and_scattered_words(spark):
    mit = lic.TEMPLATES["mit-line"]
    apart = " ".join(w + " x" * 9 for w in mit.split())
    rows = [(None, mit), (None, mit), (1, mit), (1, mit), (2, apart), (3, "word " * 60000 + mit)]
    got = lic.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "3", "None", "None"]
    assert [r.first_word for r in got if r.doc_id == 3] == [60000]


def test_empty_table(spark):
    assert lic.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
