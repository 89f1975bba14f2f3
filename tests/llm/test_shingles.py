"""Near copies by 5-word shingles against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from memspark.llm import shingles

from .test_simhash import components, plain_fingerprint


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def planted():
    """Texts with copies that differ in 0 to 9 words of 200, and texts that share most of a beginning."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in (0, 0, 1, 2, 3, 4, 5, 7, 9):
            w = list(words)
            for at in rng.sample(range(200), k):
                w[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(w))
        texts.append(" ".join(words[:170] + [f"y{rng.randrange(5000)}" for _ in range(30)]))
    return [*enumerate(texts)] + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "One"), (5005, "a b c d e " * 4000)]


def test_near_copies_match_brute_force_beyond_two_bits(spark):
    rows = planted()
    sets, prints = {d: plain_set(t) for d, t in rows}, {d: plain_fingerprint(t) for d, t in rows}
    want = components(list(sets), lambda a, b: alike(sets[a], sets[b]))
    bits = components(list(sets), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert want != bits
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in shingles.near_copies(docs).collect())
    assert got == sorted([(d, want[d]) for d, _ in rows] + [(0, want[0])])
    kept = cp.near_copies(spark, docs.distinct(), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({*want.values()})


def test_large_bands_are_split_and_lose_no_link(spark):
    """Very many texts that share half of their words, among them pairs of copies; bands of over four classes are split."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = [f"o{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * i, " ".join(own + passage)))
        for at in rng.sample(range(100), i % 4):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(own + passage)))
    sets = {d: plain_set(t) for d, t in rows}
    want = components(list(sets), lambda a, b: alike(sets[a], sets[b]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), shingles.marks_udf("text").alias("m")).select("id", "text_key", "m.*").cache()
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text")
    for group in (4, shingles.GROUP):
        links = shingles.alike_links(marked.drop("id"), texts, group)
        assert {r.id: r.component_id for r in shingles.labelled(marked.select("id", "fp"), links).collect()} == want
    own = marked.select("fp", "size", "sketch", F.col("fp").alias("component"))
    held = marked.select("fp", F.explode("bands").alias("band"))
    assert shingles.cross_pairs(held, own, 4).count() < 5 * len(rows)
    marked.unpersist()


def test_near_copies_of_one_text_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Several hundred texts alike by 0.5 to 0.79, each with a copy of its own: what is compared follows the texts, and all links are found."""
    rng = random.Random(5)
    base, rows = [f"p{i}" for i in range(150)], []
    for i in range(250):
        w = list(base)
        for at in rng.sample(range(150), 4 + i % 4):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(w[: 150 - i % 9])))
    sets = {d: plain_set(t) for d, t in rows}
    want = components(list(sets), lambda a, b: alike(sets[a], sets[b]))
    compared, plain = [], shingles._alike

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(shingles, "_alike", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()} == want
    assert len(set(want.values())) > 200
    assert sum(compared[1:]) < 4 * len(rows)


def test_first_shingles_meet_for_all_alike_sets(spark):
    """Sets of all sizes from 1 to 60 and some large ones, each with subsets and sets that differ in a few members: no alike pair is missing."""
    rng = random.Random(6)
    sets = []
    for n in [*range(1, 61), 150, 400, 401, 1000]:
        whole = [rng.randrange(400) for _ in range(n)] if n < 61 else [rng.randrange(10**9) for _ in range(n)]
        for share in (0, 1, 0.9, 0.8):
            sets.append(sorted({*whole[: max(1, round(n * share))], *(rng.randrange(10**9) for _ in range(n // 12 if share == 0 else 0))} | (set(whole) if share == 0 else set())))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "fp long, set array<long>")
    classes = frame.select("fp", F.size("set").alias("size"), F.col("fp").alias("component"))
    found = {(r.a, r.b) for r in shingles.first_pairs(classes, frame).collect()}
    plain = [set(x) for x in sets]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])}
    assert len(want) > 150
    assert want <= found


def test_sketches_estimate_the_similarity():
    rng = random.Random(2)
    for s in (0.0, 0.5, 0.8, 1.0):
        off = []
        for _ in range(50):
            n = 600
            same = round(2 * n * s / (1 + s))
            ids = [rng.getrandbits(64) for _ in range(2 * n)]
            a, b = (shingles.band_hashes(np.unique(np.array(x, np.uint64)))[1] for x in (ids[:n], ids[n - same : 2 * n - same]))
            differ = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
            off.append(1 - 2 * differ / (64 * len(a)) - s)
        assert abs(np.mean(off)) < 0.03
        assert np.std(off) < 0.06


def test_nearest_ids_of_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "A b c d"), (None, "q w e")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in shingles.near_copies(docs).collect()) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert shingles.near_copies(docs.filter(F.lit(False))).count() == 0
