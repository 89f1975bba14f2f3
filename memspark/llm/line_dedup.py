"""Line dedup: documents probe a sharded minimal perfect hash of frequent lines instead of joining lines.

A line's key is its text without blanks at both ends and with A-Z lower-cased; keys of at least
LEAST_CHARS code points count. Keys are named by 128-bit hashes. One shuffle, pre-aggregated, counts the documents
of each distinct hash and takes the largest id; those of at least LEAST_DOCS documents are dealt into shards by their
first bits, and each shard is built in one group of bounded size: a minimal perfect hash in levels (a level is a bit
array; a hash that has its slot to itself is settled there, the others go to the next level; the rank of the set
bit is its number), and by that number arrays of 64-bit fingerprints, counts and largest ids. A hash outside the index is told by its
fingerprint; with the slot 128 bits have to agree, so no line is dropped by chance.

Shards are a table in the shared folder. Up to PART_BYTES of shards make a part, which a task reads once and
keeps. If there is one part, documents are probed where they lie and nothing else is shuffled. More parts never meet
in one task: each document then sends its hashes to the parts that they belong to (dealt by part and document, so a line of
very many documents is no hot key), and what is to be dropped comes back by document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyarrow import fs

from .common import cut, join_hot, read, scratch_dir

#: Code points of a key and documents that hold it, from which on it is dropped everywhere but in the largest id.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Hashes of a shard (about), bytes of a part's arrays, bytes that a hash takes in them.
SHARD_KEYS, PART_BYTES, KEY_BYTES = 1 << 16, 128 << 20, 19
#: Slots of a level for each hash that is left; levels that a shard may have.
SLOTS, LEVELS = 1.5, 200
#: Stands for the id of rows without one: below all others.
NO_ID = -(1 << 63)
_BLANK = " \t\n\x0b\x0c\r"
_KEYS = "a long, b long, id long"
_INDEX = "part int, shard int, sizes array<long>, bits binary, prints binary, counts binary, last binary"
_RESULT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())])


def lines_of(text: str | None, least: int = LEAST_CHARS) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text (null: one empty line) and their keys; None where a key is too short."""
    lines = (text or "").split("\n")
    bare = (x.strip(_BLANK) for x in lines)
    return lines, [x.encode().lower() if len(x) >= least else None for x in bare]


def hashed(keys) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of the keys' XXH3-128."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(k) for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)


# -- the hash --------------------------------------------------------------------------------


def _slots(a: np.ndarray, b: np.ndarray, level: int, sizes) -> np.ndarray:
    x = (a ^ np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x = ((x ^ (x >> np.uint64(32))) + b) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) % sizes


def build(a: np.ndarray, b: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes (multiples of 64), their bits one after another and the order that sorts distinct hashes by number."""
    sizes, levels, order, left = [], [], [], np.arange(len(a))
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("hashes are not distinct")
        size = 64 * math.ceil(SLOTS * len(left) / 64)
        at = _slots(a[left], b[left], len(sizes), np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        order.append(left[settled][np.argsort(at[settled])])
        left = left[~settled]
        sizes.append(size)
        levels.append(alone)
    return sizes, np.concatenate(levels or [np.zeros(0, bool)]), np.concatenate(order or [left])


class Part:
    """The shards of a part, side by side: numbers of hashes and the arrays that they index."""

    def __init__(self, shards: list[dict], shard_bits: int):
        shards = sorted(shards, key=lambda s: s["shard"])
        self.shard_bits, n_levels = shard_bits, max((len(s["sizes"]) for s in shards), default=0)
        self.first = shards[0]["shard"] if shards else 0
        n = shards[-1]["shard"] - self.first + 1 if shards else 0
        self.sizes, self.starts, at = np.zeros((n, n_levels), np.uint64), np.zeros((n, n_levels), np.int64), 0
        for s in shards:
            k, row = len(s["sizes"]), s["shard"] - self.first
            self.sizes[row, :k] = s["sizes"]
            self.starts[row, :k] = at + np.cumsum([0, *s["sizes"][:-1]])
            at += sum(s["sizes"])
        glued = lambda name, kind: np.frombuffer(b"".join(s[name] for s in shards), kind)
        self.bits, self.prints, self.counts, self.last = glued("bits", "<u8"), glued("prints", "<u8"), glued("counts", "<u2"), glued("last", "<i8")
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that are not in the index."""
        found = np.full(len(a), -1, np.int64)
        rows = (a >> np.uint64(64 - self.shard_bits)).astype(np.int64) - self.first if self.shard_bits else np.zeros(len(a), np.int64) - self.first
        left = np.flatnonzero((rows >= 0) & (rows < len(self.sizes)))
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[rows[left], level] > 0]
            if not len(left):
                break
            at = self.starts[rows[left], level] + _slots(a[left], b[left], level, self.sizes[rows[left], level]).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            is_set = (word >> bit) & np.uint64(1) == 1
            number = self.ranks[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            here, number = left[is_set], number[is_set]
            same = self.prints[number] == b[here]
            found[here[same]] = number[same]
            left = left[~is_set]
        return found

    def drops(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
        """Whether the lines with these hashes go from the documents with these ids."""
        at = self.find(a, b)
        out = at >= 0
        out[out] = (self.counts[at[out]] >= least) & (self.last[at[out]] != ids[out])
        return out


_kept: dict[tuple[str, int], Part] = {}


def load(path: str, part: int, shard_bits: int) -> Part:
    """A part from the table in the shared folder; a worker keeps the last one it read."""
    if (path, part) not in _kept:
        system, root = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        found = system.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
        files = [f.path for f in found if f.path.endswith(".parquet")]
        rows = [r for f in files for r in pq.read_table(system.open_input_file(f)).to_pylist()]
        _kept.clear()
        _kept[path, part] = Part(rows, shard_bits)
    return _kept[path, part]


# -- Spark -----------------------------------------------------------------------------------


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """a, b (the hash of a key), n (documents that hold it), last (their largest id, NO_ID if none has one)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {k for k in lines_of(text, least)[1] if k is not None}
                keys += own
                owners += [i] * len(own)
            h = hashed(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("id").take(pa.array(owners, pa.int64()))], ["a", "b", "id"])

    found = docs.select(_id(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, _KEYS)
    return found.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def _id(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


class LineIndex:
    """Where an index lies: path, parts, bits of a hash that name its shard, bits that name its part."""

    def __init__(self, path: str, n_parts: int, shard_bits: int):
        self.path, self.n_parts, self.shard_bits = path, n_parts, shard_bits
        self.part_bits = n_parts.bit_length() - 1


def line_index(counts: DataFrame, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, part_bytes: int = PART_BYTES) -> LineIndex:
    """Writes the index of the hashes that least_docs documents hold at least; counts as of line_counts()."""
    frequent = cut(counts.filter(F.col("n") >= least_docs))
    n = frequent.count()
    bits = max(0, math.ceil(math.log2(max(1, n / shard_keys))))
    part_bits = min(bits, max(0, math.ceil(math.log2(max(1, n * KEY_BYTES / part_bytes)))))
    path = scratch_dir(counts.sparkSession, "line-index")

    def shard(table: pa.Table) -> pa.Table:
        a, b, n, last = (table.column(k).to_numpy() for k in ("a", "b", "n", "last"))
        at, a, b = int(table.column("shard")[0].as_py()), a.view(np.uint64), b.view(np.uint64)
        sizes, bitmap, order = build(a, b)
        row = {"part": at >> (bits - part_bits), "shard": at, "sizes": sizes, "bits": np.packbits(bitmap, bitorder="little").tobytes()}
        row |= {"prints": b[order].tobytes(), "counts": np.minimum(n[order], 65535).astype("<u2").tobytes(), "last": last[order].tobytes()}
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds)})

    at = F.shiftrightunsigned("a", 64 - bits) if bits else F.lit(0).cast("long")
    shards = frequent.withColumn("shard", at).groupBy("shard").applyInArrow(shard, _INDEX)
    shards.write.partitionBy("part").parquet(path)
    return LineIndex(path, 1 << part_bits, bits)


def _batch(texts, least: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(lines, keys) of each text, the texts' numbers and the hashes of all keys, line by line."""
    split = [lines_of(t, least) for t in texts]
    owners = [i for i, (_, keys) in enumerate(split) for k in keys if k is not None]
    return split, np.array(owners, np.int64), hashed(k for _, keys in split for k in keys if k is not None)


def _settled(split: list, gone: np.ndarray) -> pd.DataFrame:
    """n_lines, n_dropped and what is kept of each text; gone tells it of all lines with a key, one after another."""
    rows, at = [], 0
    for lines, keys in split:
        kept, before = [], at
        for line, key in zip(lines, keys):
            if key is None:
                kept.append(line)
            else:
                if not gone[at]:
                    kept.append(line)
                at += 1
        rows.append((len(lines), len(lines) - len(kept), "\n".join(kept) if at > before else "\n".join(lines)))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "text"])


def _probe_here(docs: DataFrame, index: LineIndex, id_col: str, text_col: str, least: int, least_docs: int) -> DataFrame:
    path, bits = index.path, index.shard_bits

    @F.pandas_udf(_RESULT)
    def probe(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        split, owners, h = _batch(texts, least)
        return _settled(split, load(path, 0, bits).drops(h[:, 0], h[:, 1], ids.to_numpy(np.int64)[owners], least_docs))

    return docs.withColumn("_line_dedup", probe(_id(id_col), F.col(text_col)))


def _probe_by_parts(docs: DataFrame, index: LineIndex, id_col: str, text_col: str, least: int, least_docs: int) -> DataFrame:
    path, bits, part_bits = index.path, index.shard_bits, index.part_bits

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, owners, h = _batch(batch.column("text").to_pylist(), least)
            order = np.lexsort(((parts := (h[:, 0] >> np.uint64(64 - part_bits)).astype(np.int32)), owners))
            owners, parts, h = owners[order], parts[order], h[order]
            starts = np.flatnonzero(np.r_[True, (owners[1:] != owners[:-1]) | (parts[1:] != parts[:-1])]) if len(h) else np.zeros(0, np.int64)
            chunks = [np.unique(c, axis=0).tobytes() for c in np.split(h, starts[1:])] if len(h) else []
            of = pa.array(owners[starts])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(of), batch.column("id").take(of), pa.array(parts[starts]), pa.array(chunks, pa.binary())], ["key", "id", "part", "hashes"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            rows = zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), batch.column("hashes").to_pylist())
            for i, (part, owner, chunk) in enumerate(rows):
                h = np.frombuffer(chunk, np.uint64).reshape(-1, 2)
                gone = h[load(path, part, bits).drops(h[:, 0], h[:, 1], np.full(len(h), owner), least_docs)]
                if len(gone):
                    keys.append(i)
                    out.append(gone.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(out, pa.binary())], ["key", "gone"])

    @F.pandas_udf(_RESULT)
    def settle(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        split, owners, h = _batch(texts, least)
        sets = [set() if g is None else {bytes(c[i : i + 16]) for c in g for i in range(0, len(c), 16)} for g in gone]
        return _settled(split, np.array([x.tobytes() in sets[o] for o, x in zip(owners, h)], bool))

    # Rows of equal id and text share their fate, so that pair is the name of a row.
    keyed = docs.withColumn("_line_key", F.struct(_id(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
    sent_to = keyed.select(F.col("_line_key").alias("key"), F.col("_line_key.id").alias("id"), F.col(text_col).alias("text")).mapInArrow(sent, "key struct<id: long, text: long>, id long, part int, hashes binary")
    found = sent_to.repartitionByRange("part", "key").mapInArrow(judged, "key struct<id: long, text: long>, gone binary")
    gone = cut(found.groupBy(F.col("key").alias("_line_key")).agg(F.collect_set("gone").alias("_gone")))
    return join_hot(keyed, gone, "_line_key", "left").withColumn("_line_dedup", settle(F.col(text_col), F.col("_gone"))).drop("_line_key", "_gone")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, part_bytes: int = PART_BYTES
) -> DataFrame:
    """docs with n_lines, n_dropped and text as it stays, of every row: the id column, n_lines, n_dropped, text.

    Each row is a document (rows that repeat count each, and keep a line together if they have the largest id).
    A null id is below all others. A null or empty text is one empty line. Texts all of whose lines go become empty.
    Other columns don't matter. An empty table gives no rows."""
    docs = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    index = line_index(line_counts(docs, id_col, text_col, least_chars), least_docs, shard_keys, part_bytes)
    probe = _probe_here if index.n_parts == 1 else _probe_by_parts
    return probe(docs, index, id_col, text_col, least_chars, least_docs).select(id_col, "_line_dedup.*")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
v AS (SELECT k.*, coalesce(c.last <> k.doc_id, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (gone)::bigint AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""
