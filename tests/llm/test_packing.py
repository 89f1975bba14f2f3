"""Packing against a plain best-fit and the constraints."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from memspark.llm import packing


def plain_best_fit(pieces, capacity):
    bins, out = [], []
    for tokens, source, cluster in pieces:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= tokens and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if i == len(bins):
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= tokens
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
    return out


def test_best_fit_matches_the_plain_one():
    rng = random.Random(4)
    for n in (0, 1, 7, 400):
        pieces = sorted(((rng.randrange(0, 65), rng.choice("aaabcdef") if rng.random() < 0.9 else None, rng.choice([None, "x", rng.randrange(99)])) for _ in range(n)), key=lambda p: -p[0])
        assert packing.best_fit(pieces, 64) == plain_best_fit(pieces, 64)


def test_bins_hold_no_conflict_and_every_token_once(spark):
    rng = random.Random(5)
    texts = ["w " * rng.choice([1, 5, 30, 64, 65, 700]) + str(i) for i in range(300)] + ["copy of a text"] * 150 + [None, "", " \n"]
    rows = [(i, t, rng.choice(["hot", "hot", f"s{i % 9}", None]), 3) for i, t in enumerate(texts)] + [(None, "no id", "hot", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    got = packing.packed(docs, capacity=64, shard_pieces=200).collect()
    by_doc, bins, info = defaultdict(int), defaultdict(list), {r[0]: r for r in rows}
    for r in got:
        by_doc[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    assert by_doc == {i: len((t or "").split()) for i, t, *_ in rows} | {None: 4}
    assert len({b >> 32 for b in bins}) > 5
    for held in bins.values():
        held.sort(key=lambda r: (r.start, r.n_tokens))
        assert sum(r.n_tokens for r in held) <= 64
        assert all(a.start + a.n_tokens == b.start for a, b in zip(held, held[1:]))
        sources = [info[r.doc_id][2] for r in held if info[r.doc_id][2]]
        copies = [info[r.doc_id][1] for r in held if r.n_tokens]
        assert len(sources) == len(set(sources)) and len(copies) == len(set(copies))


def test_rows_that_repeat_spread_over_bounded_shards(spark):
    one = spark.range(30_000).selectExpr("7L as doc_id", "'a b c' as text", "cast(null as string) as source")
    got = packing.packed(one).groupBy((F.col("bin_id") / (1 << 32)).cast("int").alias("s")).count().collect()
    assert len(got) == 15 and sum(r["count"] for r in got) == 30_000 and max(r["count"] for r in got) < 2 * packing.SHARD_PIECES


def test_shards_cost_little_room(spark):
    """Bins of sharded packing against those of one best fit over all pieces."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 60), f"s{rng.randrange(300)}") for i in range(6000)], "doc_id long, text string, source string")
    a, b = (packing.packed(docs, F.col("doc_id").cast("string"), 64, n).select("bin_id").distinct().count() for n in (500, 10**9))
    assert a <= 1.05 * b


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
