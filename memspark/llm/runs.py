"""Periodic runs of words, by longest common extensions on a harmonic grid.

A run is a stretch of words with smallest period q and a length of at least max(LEAST, 3 q) that no neighbour extends.
For each period p the grid has the points 0, p, 2 p, ...; a run of period p and length 3 p or more holds, in its first p
words, one grid point j p, so that the texts from j p and from (j + 1) p agree for over p words forwards
and for under p words backwards. Both extensions are looked up: forwards in the text's suffix array with a
range-minimum table over the longest common prefixes of neighbours, backwards in those of the reversed text. The grids
of all periods together have n ln n points. Points whose next words differ can't pass and are left out before.
An interval found with several periods has the least of them as its smallest period.

Texts are worked one by one inside a task, in whole; a text of n words takes about 4 log2(n) bytes a word and
array, and points of the grid are taken in chunks of CHUNK."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: Words that a run has at least, periods that it has at least.
LEAST, PERIODS = 24, 3
#: Grid points worked at once.
CHUNK = 1 << 20
_RUN = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])


class Extensions:
    """Longest common extensions of two places of a sequence: suffix array, neighbours' common prefixes, range minima."""

    def __init__(self, symbols: np.ndarray):
        """symbols: whole numbers from 0 on, in any order."""
        n = len(symbols)
        # Prefix doubling: ranks by the first 2^k symbols; places behind the end come first.
        ranks, k = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)], 1
        order = np.argsort(ranks[0], kind="stable")
        while n and ranks[-1].max() + 1 < n:
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - k)] = ranks[-1][k:] + 1
            key = ranks[-1] * (n + 1) + behind
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.r_[0, key[order[1:]] != key[order[:-1]]])
            ranks.append(np.empty(n, np.int64))
            ranks[-1][order] = new
            k *= 2
        self.rank = ranks[-1]
        # Common prefixes of neighbours, by halving steps over the kept ranks.
        a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
            # Equal ranks of 2^level symbols that run over the end would be the same place, so both lie inside.
            lcp[same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level
        self.table = [lcp.astype(np.int32)]
        while 2 << len(self.table) - 1 <= len(lcp):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols agree from x and from y on; x and y differ pair by pair."""
        i, j = self.rank[x], self.rank[y]
        low, high = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def grid(n: int, least: int, symbols: np.ndarray):
    """Chunks of (period, point) of the harmonic grid at which as many next words agree as any run needs."""
    last = n // PERIODS
    sizes = (n - 1) // np.arange(1, last + 1)
    ends = np.cumsum(sizes)
    at = 0
    while at < last:
        # At least one period, as many as make a chunk.
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        periods = np.repeat(np.arange(at + 1, to + 1), sizes[at:to])
        firsts = np.repeat(ends[at:to] - sizes[at:to] - (ends[at - 1] if at else 0), sizes[at:to])
        points = (np.arange(len(periods)) - firsts) * periods
        # A run needs over p words forwards, and least - p of them less the under p words backwards.
        for d in range(1 + least // 3):
            need = np.maximum(periods + 1, least - 2 * periods + 1) > d
            inside = points + periods + d < n
            same = np.zeros(len(points), bool)
            same[inside] = symbols[points[inside] + d] == symbols[points[inside] + periods[inside] + d]
            keep = same | ~need
            periods, points = periods[keep], points[keep]
        yield periods, points
        at = to


def runs_of(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period."""
    n = len(symbols)
    none = np.zeros((0, 3), np.int64)
    if n < max(least, PERIODS):
        return none
    found = [c for c in grid(n, least, symbols) if len(c[0])]
    if not found:
        return none
    periods, points = (np.concatenate(x) for x in zip(*found))
    forwards = Extensions(symbols)(points, points + periods)
    keep = forwards > periods
    periods, points, forwards = periods[keep], points[keep], forwards[keep]
    if not len(periods):
        return none
    # Word i is word n - 1 - i of the reversed text; behind the first word there is nothing to agree.
    backwards, inner = np.zeros(len(points), np.int64), points > 0
    if inner.any():
        backwards[inner] = Extensions(symbols[::-1])(n - points[inner], n - points[inner] - periods[inner])
    length = backwards + forwards + periods
    keep = (backwards < periods) & (length >= np.maximum(least, PERIODS * periods))
    found = np.stack([points - backwards, length, periods], 1)[keep]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)] if len(found) else np.zeros(0, bool)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word lies in a run behind that run's first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps)[:n] > 0


def periodic_runs(text: Column, least: int = LEAST) -> Column:
    """Struct of n_words, runs (start, length, period; by start, then period) and collapsed of each whole text.

    Words are numbered from 0 and compared with case; collapsed has those that lie in no run behind that run's first period,
    joined by one space, all words if there is no run. A null, empty or blank text has no words, no runs and '' as
    collapsed. Rows that repeat are worked each for itself."""

    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            split = text.encode().split() if text else []
            names: dict[bytes, int] = {}
            symbols = np.fromiter((names.setdefault(w, len(names)) for w in split), np.int64, len(split))
            runs = runs_of(symbols, least)
            if len(runs):
                split = [w for w, gone in zip(split, dropped(len(split), runs).tolist()) if not gone]
            rows.append((len(symbols), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], b" ".join(split).decode()))
        return pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return find(text)


def best(runs: str) -> Column:
    """The run of the array with the greatest exact length / period; ties by smallest start, then period."""
    better = "(b.length * a.period > a.length * b.period OR b.length * a.period = a.length * b.period AND (b.start < a.start OR b.start = a.start AND b.period < a.period))"
    return F.expr(f"aggregate({runs}, get({runs}, 0), (a, b) -> if({better}, b, a))")


def repeated(split: list, h: int) -> list:
    """Words with those from some place on replaced by repeats of a stretch; h says where, how long, and whether at all."""
    n, g = len(split), h // 10
    if h % 10 or not n:
        return split
    a = g % n
    stretch = split[a : a + 1 + (n - a) // (3 + g % 8)]
    return split[:a] + (stretch * (n // len(stretch) + 1))[: n - a]


@F.pandas_udf(T.StringType())
def planted(hashes: pd.Series, texts: pd.Series) -> pd.Series:
    """Texts of rows whose hash divides by 10 with repeats planted, others (and those without a hash) as they are."""
    plant = lambda h, t: b" ".join(repeated(t.encode().split(), int(h))).decode()
    return pd.Series([plant(h, t) if t and h % 10 == 0 else t for h, t in zip(hashes, texts)], dtype=object)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", planted(F.crc32(F.col("doc_id").cast("string")), "text").alias("text")).select("doc_id", periodic_runs(F.col("text")).alias("r"))
    told = found.select("doc_id", "r.runs", "r.collapsed", best("r.runs").alias("best"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
