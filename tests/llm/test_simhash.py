"""SimHash near-duplicates against brute force."""

import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from memspark.llm import simhash
from memspark.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcÀ \t\n", max_size=80))
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_settle_on_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (None, 3), (9, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(200, 400)} | {8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matches_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)] for _ in range(8)]
    rows, i = [], 0
    for words in base:
        for _ in range(12):
            w = list(words)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(9))
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one"), (i + 4, "One two"), (0, rows[0][1]), (i + 5, "A b c " * 5000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, fp int")
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = {d: plain_fingerprint(t) for d, t in rows}
    want = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == sorted((d, prints[d], want[d]) for d, _ in rows)
    assert len(set(want.values())) < len(want)


def test_planted_bit_flips_link_at_two_and_not_at_three(spark):
    fps = [0, 1, 3, 1 << 63, -1, 0b111 << 20, (1 << 62) + 5]
    as_long = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.variant_links(spark.createDataFrame([(f,) for f in as_long], "fp long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = components(as_long, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    assert {n: want[n] for n in got} == got
    assert set(as_long) - set(got) == {n for n in want if list(want.values()).count(want[n]) == 1}


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "q w e")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]
