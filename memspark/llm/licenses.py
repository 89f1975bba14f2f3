"""License scans by patience alignment.

Words that occur once in a stretch of text and once in the template are anchors (where no word does,
runs of two to four words are); the longest run of anchors in the same order in both is kept, and the
gaps between them are aligned the same way. The share of the template's words that are matched is its
coverage.

Where to align: of a text only the template's own words are looked at. Runs of them that the template
has, too, say where it would begin; beginnings that lie close together make one stretch. A passage of
coverage 0.8 whose words were left out or exchanged has such a run: its missing words cut it into pieces, one of
which has three words at least (two in short templates). Template words put in after every second word can break
all such runs; of texts so made, which align() covers by 0.8, about one in five is missed (none with one after
every third word). What was found is taken out, and what is left between is searched
again until nothing is found."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: Coverage of a template from which on a passage is reported.
COVERAGE = 0.8
#: Lengths of runs of words that serve as anchors, in order of trial; template lengths of text that a passage spans at most.
RUNS, LENGTHS = (1, 2, 3, 4), 2

# Short license notices as their publishers word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARKS = b".,;:!?\"'()[]{}<>*#|&$%-_/\\"


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and marks taken out; words of marks alone stay as empty words, so places count as in the text."""
    if not text:
        return []
    raw = text.encode().translate(_LOWER)
    return [w.translate(None, _MARKS) for w in raw.split()]


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    ends: list[int] = []
    tails: list[int] = []
    back: list[int] = []
    for k, p in enumerate(places):
        at = bisect_left(ends, p)
        back.append(tails[at - 1] if at else -1)
        ends[at : at + 1] = [p]
        tails[at : at + 1] = [k]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _anchors(a: list[bytes], b: list[bytes], n: int) -> list[tuple[int, int]]:
    """Places of runs of n words that occur once in a and once in b: the longest increasing run of them."""
    runs = lambda x: list(x) if n == 1 else list(zip(*(x[k:] for k in range(n))))
    of_a, of_b = runs(a), runs(b)
    in_a, in_b = Counter(of_a), Counter(of_b)
    at = {w: i for i, w in enumerate(of_a) if in_a[w] == 1}
    met = [(at[w], j) for j, w in enumerate(of_b) if in_b[w] == 1 and w in at]
    return [met[x] for x in increasing([p for p, _ in met])]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both: equal ends of a stretch, then anchors, then the gaps between them."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i >= j or k >= m:
            continue
        for n in RUNS:
            if kept := [(i + x, k + y) for x, y in _anchors(a[i:j], b[k:m], n)]:
                found += kept
                edges = [(i - 1, k - 1), *kept, (j, m)]
                todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
                break
    return sorted(found)


class _Template:
    def __init__(self, name: str, words: list[bytes]):
        self.name, self.words, self.counts, self.own = name, words, Counter(words), set(words)
        self.run = 3 if len(words) >= 12 else 2 if len(words) >= 4 else 1
        self.runs: dict[tuple, list[int]] = {}
        for j in range(len(words) - self.run + 1):
            self.runs.setdefault(tuple(words[j : j + self.run]), []).append(j)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [_Template(name, t) for name, t in ((n, [w for w in words(x) if w]) for n, x in templates.items()) if t]
        self.known = set().union(*(t.own for t in self.templates)) if self.templates else set()

    def _matched(self, here: list[bytes], places: list[int], t: _Template) -> tuple[float, int, int] | None:
        """(coverage, first and last index in here) of the template's passage, at most LENGTHS template lengths of text long."""
        size, pairs = len(t.words), []
        if sum((Counter(here) & t.counts).values()) >= self.coverage * size:
            pairs = [i for i, _ in align(here, t.words)]
        while pairs and places[pairs[-1]] - places[pairs[0]] >= LENGTHS * size:
            # The end that is farther from its neighbour goes.
            pairs = pairs[1:] if len(pairs) > 1 and places[pairs[1]] - places[pairs[0]] >= places[pairs[-1]] - places[pairs[-2]] else pairs[:-1]
        return (len(pairs) / size, pairs[0], pairs[-1]) if pairs and len(pairs) >= self.coverage * size else None

    def _search(self, seq: list[bytes], places: list[int], t: _Template) -> list[tuple[float, int, int]]:
        """(coverage, first, last index in seq) of all passages of a template; seq: its own words in a text."""
        size, out, todo = len(t.words), [], [(0, len(seq))]
        slack, near = size // 4 + 2, max(2, size // 10)
        while todo:
            low, high = todo.pop()
            starts = sorted({i - j for i in range(low, high - t.run + 1) for j in t.runs.get(tuple(seq[i : i + t.run]), ())})
            groups: list[list[int]] = []
            for s in starts:
                if groups and s - groups[-1][1] <= near and s - groups[-1][0] <= slack:
                    groups[-1][1] = s
                else:
                    groups.append([s, s])
            seen = []
            for first, last in groups:
                for a, b in {(first, last + size), (first - slack, last + size + slack)}:
                    a, b = max(low, a), min(high, b)
                    if b - a >= self.coverage * size and (hit := self._matched(seq[a:b], places[a:b], t)):
                        seen.append((hit[0], a + hit[1], a + hit[2]))
            taken: list[tuple[float, int, int]] = []
            for c, x, y in sorted(set(seen), key=lambda r: (-r[0], r[2] - r[1], r[1])):
                if all(y < p or x > q for _, p, q in taken):
                    taken.append((c, x, y))
            if taken:
                out += taken
                taken.sort(key=lambda r: r[1])
                edges = [low - 1, *(v for _, x, y in taken for v in (x, y)), high]
                todo += [(p + 1, q) for p, q in zip(edges[::2], edges[1::2]) if q - p - 1 >= self.coverage * size]
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, past the last) of each passage, by place; passages of one template don't overlap."""
        all_words = words(text)
        present = self.known.intersection(all_words)
        out = []
        for t in self.templates:
            if sum(t.counts[w] for w in present if w in t.counts) < self.coverage * len(t.words):
                continue
            places = [i for i, w in enumerate(all_words) if w in t.own]
            out += [(t.name, c, places[x], places[y] + 1) for c, x, y in self._search([all_words[i] for i in places], places, t)]
        return sorted(out, key=lambda r: (r[2], r[0]))


def passages(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs: doc_id, text. One row for each passage of each whole text: doc_id, license, coverage, first_word, end_word.

    A passage's matched words cover at least `coverage` of the template's and lie within LENGTHS template lengths of text. Texts without one (null and empty
    ones too) give no rows; repeated rows and null ids give theirs. An empty table gives no rows."""
    chosen = TEMPLATES if templates is None else templates
    kind = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))

    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.Series:
        scanner = Scanner(chosen, coverage)
        return pd.Series([[dict(zip(("license", "coverage", "first_word", "end_word"), r)) for r in scanner.scan(t)] for t in texts])

    return docs.select("doc_id", F.inline(scan("text")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))
