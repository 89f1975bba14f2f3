"""Line dedup against a plain version, the perfect hash by itself, and the edge cases of the docstring."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from memspark.llm import line_dedup as ld

BLANK = " \t\n\x0b\x0c\r"


def plain(rows):
    """rows: (id, text). The result by definition, rows in order."""
    holders = defaultdict(list)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    low = lambda i: float("-inf") if i is None else i
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(low(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != low(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_each_hash_has_a_number_of_its_own():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70000):
        a, b = rng.integers(0, 1 << 64, (2, n), dtype=np.uint64)
        sizes, bits, order = ld.build(a, b)
        shard = {"shard": 0, "sizes": sizes, "bits": np.packbits(bits, bitorder="little").tobytes(), "prints": b[order].tobytes(), "counts": np.full(n, 3, "<u2").tobytes(), "last": a[order].view(np.int64).tobytes()}
        part = ld.Part([shard], 0)
        at = part.find(a, b)
        assert sorted(at.tolist()) == list(range(n))
        assert (part.last[at].view(np.uint64) == a).all()
        other = rng.integers(0, 1 << 64, (2, 1000), dtype=np.uint64)
        assert (part.find(*other) == -1).all()
        assert sum(sizes) <= 4.5 * n + 64 * 40
    with pytest.raises(ValueError, match="distinct"):
        ld.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


LONG = "a line of at least twenty code points"
ROWS = [
    (1, f"{LONG}\nown line of the first document\n  {LONG.upper()}\t"),
    (2, f"{LONG}\n{LONG}"),
    (2, f"{LONG}\n{LONG}"),
    (5, f"short\n{LONG}\nshort"),
    (3, "short\nshort"),
    (4, "nineteen code point\nßßßßßßßßßßßßßßßßßßßß"),
    (6, "nineteen code point\nßßßßßßßßßßßßßßßßßßßß"),
    (7, "nineteen code point\nßßßßßßßßßßßßßßßßßßßß\nÄ LINE WITH AN UMLAUT IN IT"),
    (8, "ä line with an umlaut in it\nÄ line with an umlaut in it"),
    (9, "Ä line with an umlaut in it"),
    (None, f"{LONG}\nnull rows hold it, and so they all keep it"),
    (None, "null rows hold it, and so they all keep it"),
    (None, "null rows hold it, and so they all keep it"),
    (10, None),
    (11, ""),
    (12, "\n\n"),
    (-5, "\n".join(f"{LONG} {i % 50}" for i in range(3000))),
    (-6, "\n".join(f"{LONG} {i}" for i in range(40))),
    (-7, "\n".join(f"{LONG} {i}" for i in range(45)) + "\r"),
]


@pytest.mark.parametrize("many", [False, True])
def test_edge_cases_equal_the_plain_version(spark, many):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], "doc_id long, text string, n_lines string, _line_key string")
    sizes = {"shard_keys": 4, "part_bytes": 200} if many else {}
    got = Counter(map(tuple, ld.dedup_lines(docs, **sizes).collect()))
    assert got == plain(ROWS)


def test_several_parts_give_what_one_gives(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = Counter(map(tuple, ld.dedup_lines(docs).collect()))
    assert one == plain([(r.doc_id, r.text) for r in docs.collect()])
    counts = ld.line_counts(docs)
    assert ld.line_index(counts, 2, shard_keys=8, part_bytes=500).n_parts > 2
    assert Counter(map(tuple, ld.dedup_lines(docs, least_docs=2, shard_keys=8, part_bytes=500).collect())) == Counter(map(tuple, ld.dedup_lines(docs, least_docs=2).collect()))


def test_empty_table_and_other_thresholds(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup_lines(empty).collect() == []
    docs = spark.createDataFrame([(1, "ab\nc"), (2, "AB")], "doc_id int, text string")
    assert sorted(map(tuple, ld.dedup_lines(docs, least_chars=2, least_docs=2).collect())) == [(1, 2, 1, "c"), (2, 1, 0, "AB")]
