"""Near copies of texts: alike are texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same set are one class. Ball hashing of the SimHash of its shingles (simhash.variant_links) finds classes
within two bits. Sets of similarity 0.8 differ in about ten of 64 bits, which no ball of a size that can be emitted
reaches, so candidates come from minima, too: a class emits BANDS hashes, each of ROWS minima of its shingles
under random orders; two classes of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS,
which is 0.999997 at 0.8 and more above. Candidates are compared first with one class of each of their bands, that with the most company. Then
only bands that still hold several components matter. Of one with GROUP classes at most all pairs of classes of
different components are compared. Classes of larger ones meet by their rarest shingles: of two sets of similarity 0.8
with m <= n members at least 4/9 (m + n) are common, so in any one order of all shingles the first members of both, as many as may be
missing and one more, have one in common. The order puts shingles that a single component holds first, then rare ones before
frequent ones, and classes meet by spans of sizes a fiftieth apart, so the first members are a ninth of a set where sizes are equal. Texts that
share a passage but differ by more than that have only shingles of their own there, however many they are; none is left out.

Before whole sets are fetched, candidates are sifted by sketches: BITS bits of each minimum. Their agreement
estimates the similarity with a deviation of 0.036 at 0.8; pairs under LIKELY lie over five deviations below."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_hot, words_of
from .components import connected_components
from .simhash import fingerprint_of, variant_links

SEED, SHINGLE_WORDS, LEAST = 42, 5, 0.8
BANDS, ROWS = 32, 5
#: Bits of a minimum in a sketch; estimate from which on whole sets are compared; classes of a band that are compared pair by pair; ratio of sizes that meet in one span.
BITS, LIKELY, GROUP, SPAN = 4, 0.6, 4, 1.02
#: Texts to compare up to which their names are broadcast.
BROADCAST_TEXTS = 1_000_000
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_FACTORS, _MASKS = _ORDERS[0] | np.uint64(1), _ORDERS[1]
_MARKS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("sim", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct XXH64 of a whole text's 5-word shingles; a shorter text is one shingle, no words: none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), min(SHINGLE_WORDS, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def band_hashes(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS hashes of a set of shingles, and its sketch; the empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        least = np.minimum(least, ((found[i : i + 2048, None] ^ _MASKS) * _FACTORS).min(0))
    data, step = least.tobytes(), 8 * ROWS
    hashes = np.array([xxhash.xxh64_intdigest(data[k * step : k * step + step], k) for k in range(BANDS)], np.uint64).view(np.int64)
    # Minima are small numbers, so they are mixed before their first bits are taken.
    mixed = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    per = 64 // BITS
    packed = (mixed.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)
    return hashes, packed.view(np.int64)


@F.pandas_udf(_MARKS)
def marks_udf(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
    bands, sketches = zip(*map(band_hashes, sets)) if sets else ((), ())
    marks = {"fp": keys, "size": np.array([len(s) for s in sets], np.int32), "sim": np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)}
    return pd.DataFrame(marks | {"bands": list(bands), "sketch": list(sketches)})


@F.pandas_udf(T.ArrayType(T.LongType()))
def set_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts])


def _sets_of(fps: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """fp and set of the classes fps (fp, distinct). Only their sets are made and dealt out."""
    wanted = cut(classes.join(fps, "fp", "left_semi").select("fp", "text_key"))
    # Names of wanted texts are broadcast up to a number; beyond it all texts are shuffled.
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    whole = texts.join(some, "text_key").groupBy("fp").agg(F.min("text").alias("text"))
    return cut(whole.select("fp", set_udf("text").alias("set")))


def _alike(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are alike. Only sets of classes in a pair are fetched, and narrow rows meet at a hot class first."""
    pairs = cut(pairs)
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), classes, texts)
    left, right = (sets.select(F.col("fp").alias(k), F.col("set").alias(f"of_{k}")) for k in "ab")
    met = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return met.filter(both / (F.size("of_a") + F.size("of_b") - both) >= LEAST).select("a", "b")


def _fit(a: str, b: str):
    """Whether sets of these sizes can be alike."""
    return F.least(a, b) / F.greatest(a, b) >= LEAST


def _likely(a: str, b: str):
    """Whether the sketches let two sets be alike. Bits of equal minima agree, of others half."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return differ <= int((1 - LIKELY) / 2 * BANDS * ROWS * BITS)


def ball_pairs(classes: DataFrame) -> DataFrame:
    """Pairs a < b of classes to compare: of each fingerprint its smallest class with the others, and those of linked fingerprints."""
    sims = classes.select("sim", "fp", "size")
    first = cut(sims.groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("low")))
    same = join_hot(cut(sims), first, "sim").filter("fp <> low.fp").filter(_fit("size", "low.size")).select("low.fp", F.col("fp").alias("other"))
    of = lambda k: first.select(F.col("sim").alias(k), F.col("low.fp").alias(f"f{k}"), F.col("low.size").alias(f"s{k}"))
    near = variant_links(first.select(F.col("sim").alias("fp"))).join(of("a"), "a").join(of("b"), "b").filter(_fit("sa", "sb")).select("fa", "fb")
    both = same.toDF("a", "b").unionByName(near.toDF("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sizes and sketches let them be alike."""
    of = lambda k: classes.select(F.col("fp").alias(k), F.col("size").alias(f"s{k}"), F.col("sketch").alias(f"k{k}"))
    met = join_hot(join_hot(pairs, of("a"), "a"), of("b"), "b")
    return met.filter(_fit("sa", "sb")).filter(_likely("ka", "kb")).select("a", "b")


def _shared(m, n):
    """The fewest common members of alike sets with m and n."""
    return F.ceil((m + n) * (LEAST / (1 + LEAST)) - 1e-6)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs a, b of rows (key, fp, size, component) that share a key, differ in component and let sets be alike, by their sizes and where the key is in their order (at), if that is given."""
    of = lambda k, df: df.select("key", *[F.col(c).alias(f"{k}_{c}") for c in ("fp", "size", "component", *["at"] * ("at" in df.columns))])
    met = of("x", left).join(of("y", right), "key").filter("x_component <> y_component").filter(_fit("x_size", "y_size"))
    if "at" in left.columns:
        shared = _shared(F.col("x_size"), F.col("y_size"))
        met = met.filter((F.col("x_at") <= F.col("x_size") - shared) & (F.col("y_at") <= F.col("y_size") - shared))
    return met.select(F.least("x_fp", "y_fp").alias("a"), F.greatest("x_fp", "y_fp").alias("b"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Of rows (key, fp, component, ...) those of keys with several components, with n and the component that most have (base)."""
    by_component = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = by_component.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("c")).filter("c > 1")
    return rows.join(cut(keys.select("key", "n", F.col("most.component").alias("base"))), "key")


def _firsts(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """classes: fp, size, component; sets: fp, set. Rows (key, fp, size, component, own, at) of the first shingles of each class.

    A key is a shingle and a span of sizes; own: the class has a size of that span, else it looks for smaller ones there; at: the shingle's place in the class's order, from 0."""
    rows = sets.join(classes.select("fp", "component"), "fp").select("fp", "component", F.explode("set").alias("shingle"))
    # Shingles of one component come first in the order and lead to no other, so their number is all that matters.
    held = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    common = cut(held.filter("low <> high").select("shingle", "n"))
    met = join_hot(rows.select("fp", "shingle"), common, "shingle")
    ordered = met.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("order")).join(classes, "fp")
    span = lambda n: F.floor(F.log(n) / math.log(SPAN) + 1e-9)
    smallest = F.ceil(F.col("size") * LEAST - 1e-6)
    spans = ordered.select("*", smallest.alias("smallest"), F.explode(F.sequence(span(smallest), span(F.col("size")))).alias("span"))
    # The least size of a span is taken a trifle lower, as logarithms are rounded.
    partner = F.greatest("smallest", F.ceil(F.pow(F.lit(SPAN), F.col("span")) * (1 - 1e-9)))
    shared = _shared(partner, F.col("size"))
    # Of size - shared + 1 first shingles those of one component are left out.
    left = F.size("order") - shared + 1
    firsts = spans.select("fp", "size", "component", "span", (F.col("span") == span(F.col("size"))).alias("own"), (F.col("size") - F.size("order")).alias("alone"), F.posexplode(F.slice("order", 1, F.greatest(left, F.lit(0)).cast("int"))).alias("i", "first"))
    return firsts.select(F.xxhash64("first.shingle", "span").alias("key"), "fp", "size", "component", "own", (F.col("alone") + F.col("i")).alias("at"))


def first_pairs(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """classes: fp, size, component; sets: fp, set. Pairs a, b of different components that share one of their first shingles: all alike ones are among them."""
    rows = cut(_mixed(_firsts(classes, sets)))
    # The smaller class of a pair has a size of the span. The base's classes meet the others alone, never each other.
    own, other = rows.filter("own"), rows.filter("component <> base")
    found = _met(own.filter("component <> base"), rows).unionByName(_met(own.filter("component = base"), other.filter("not own")))
    return found.distinct()


def cross_pairs(held: DataFrame, classes: DataFrame, group: int = GROUP, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """held: band, fp of bands with several classes; classes: fp, size, sketch, component. Likely pairs a, b: classes of different components that share a band.

    Of a band with group classes at most all meet; the others' sets, which fetch gives for their fp, meet by their first
    shingles. Without fetch only the former are looked at."""
    own = classes.select("fp", "size", "component")
    rows = cut(_mixed(held.select(F.col("band").alias("key"), "fp").join(own, "fp")))
    few = rows.filter(F.col("n") <= group)
    pairs = _met(few.filter("component <> base"), few)
    if fetch is not None:
        many = cut(rows.filter(F.col("n") > group).select("fp", "size", "component").distinct())
        pairs = pairs.unionByName(first_pairs(many, fetch(many.select("fp"))))
    return _sifted(cut(pairs.distinct()), classes)


def alike_links(classes: DataFrame, texts: DataFrame, group: int = GROUP) -> DataFrame:
    """classes: fp, size, sim, bands, sketch, text_key, one row per class; texts: text_key, text. Returns links a, b that join all alike classes found."""
    emitted = classes.select("fp", F.explode("bands").alias("band"))
    shared = emitted.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    held = cut(emitted.join(shared, "band"))
    # The middle of a band is the class that meets most others in all its bands: the text that others were edited from, rather than one of them.
    known = cut(held.join(held.groupBy("fp").agg(F.sum("n").alias("known")), "fp"))
    middle = known.groupBy("band").agg(F.max(F.struct("known", "fp")).alias("m")).select("band", F.col("m.fp").alias("low"))
    stars = known.join(middle, "band").filter("fp <> low").select(F.least("low", "fp").alias("a"), F.greatest("low", "fp").alias("b")).unionByName(ball_pairs(classes)).distinct()
    links = cut(_alike(_sifted(cut(stars), classes), classes, texts))
    of = connected_components(links).withColumnRenamed("node", "fp")
    own = cut(classes.select("fp", "size", "sketch").join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    return links.unionByName(_alike(cross_pairs(held.select("band", "fp"), own, group, lambda fps: _sets_of(fps, classes, texts)), classes, texts))


def labelled(marked: DataFrame, links: DataFrame) -> DataFrame:
    """marked: id, fp; links: a, b between values of fp. Returns id, fp and component_id, the smallest id that the links reach."""
    classes = marked.groupBy("fp").agg(F.min("id").alias("first"))
    found = connected_components(links).withColumnRenamed("node", "fp")
    linked = found.join(classes, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(least, "component").select("fp", "least")
    labels = classes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return join_hot(marked, labels, "fp").select("id", "fp", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes and components of whole texts.

    Returns one row for each input row: the id column, fp (long, the class) and component_id, the smallest id
    reachable by alike texts, itself included. Texts without words (null too) are one class; rows that repeat stay; a
    null id gets the smallest id of its component, null if there is none. An empty table gives no rows."""
    text = F.col(text_col)
    key = F.xxhash64(text).alias("text_key")
    marked = cut(docs.select(F.col(id_col).alias("id"), key, marks_udf(text).alias("m")).select("id", "text_key", "m.*"))
    classes = cut(marked.groupBy("fp").agg(F.min(F.struct("text_key", "size", "sim", "bands", "sketch")).alias("m")).select("fp", "m.*"))
    links = alike_links(classes, docs.select(key, text.alias("text")))
    return labelled(marked.select("id", "fp"), links).withColumnRenamed("id", id_col)
