"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits itself and its 64 one-bit variants. Two
fingerprints differ in at most two bits exactly if they emit a common variant,
so one shuffle on variants finds every link. At most 65 fingerprints can meet in
a variant, whatever the data; each is linked with the smallest of them (all of
them lie within two bits of each other) instead of with all others."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_hot, read, words_of
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash, unsigned, over XXH64 of the 3-word shingles with repeats; no words: 0."""
    words = words_of(text)
    if not words:
        return 0
    joined, n = b" ".join(words), min(SHINGLE_WORDS, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the 64-bit hashes; none: 0."""
    if not len(hashes):
        return 0
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BITS) > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits.ravel(), bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def variant_links(fingerprints: DataFrame) -> DataFrame:
    """fingerprints: distinct longs fp. Returns links a, b (a < b) that join all fingerprints within two bits."""
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]
    emitted = fingerprints.select("fp", F.explode(F.array(*flips)).alias("variant"))
    met = emitted.select(F.col("fp").alias("b"), F.min("fp").over(Window.partitionBy("variant")).alias("a"))
    return met.filter("a <> b").filter("bit_count(a ^ b) <= 2").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints and components of whole texts.

    Returns one row for each input row: the id column, fp (long), component_id (the smallest
    id reachable by links of two bits at most, itself included). A null or empty text has
    fingerprint 0 and links like any other; rows that repeat stay; a null id is a row without
    a name: it gets the smallest id of its component, null if there is none. Other columns
    don't matter. An empty table gives no rows."""
    marked = cut(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    classes = marked.groupBy("fp").agg(F.min("id").alias("first"))
    found = connected_components(variant_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    linked = found.join(classes, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(least, "component").select("fp", "least")
    labels = classes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return join_hot(marked, labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
