"""License scans by patience alignment against templates.

Where a text has enough of a template's words near each other, the stretch is aligned with the template: words that
occur once in both are anchors, the longest increasing run of anchors is kept, and the gaps between are aligned the
same way; a gap without anchors is aligned from its ends and by its longest common run. Coverage is the share of the
template's words that the alignment matches.

A cheap exact bound comes first: coverage can't exceed the share of template words (with repeats) that the text has at
all, so other texts are passed over without loss. Templates are a parameter: a list that the caller bounds.

Defined results: a null or empty text has no license; texts that repeat a notice get a row for each stretch; a notice
may be spread over twice its template's length; repeated rows each get their rows; an empty table gives none; of
templates over the same words those with the most matched words are reported, equals all (words may stand between a
template's, all together as many as it has); very long texts are scanned whole, by windows of a few template lengths, in time linear in theirs; columns other than the id and the text are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

COVERAGE = 0.8
#: Wordings of public license notices.
TEMPLATES = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "sentence", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

#: Characters of a cell in which stretches are looked up.
CELL = 256

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Words so common in prose that they don't open or bound a stretch.
_COMMON = frozenset("a an and any as at be by for from if in is it may not of on or shall that the this to was with you".split())


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-cased words with their begins and ends."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by piles (patience)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        once = {w: p for p, w in enumerate(b[k:m], k) if cb[w] == 1 and ca.get(w) == 1}
        pairs = [(p, once[w]) for p, w in enumerate(a[i:j], i) if w in once]
        anchors = [pairs[x] for x in increasing([q for _, q in pairs])]
        if not anchors:
            # no word is unique on both sides: the longest common run is the anchor
            run: dict[int, int] = {}
            best = (0, 0, 0)
            where: dict[str, list[int]] = {}
            for q in range(k, m):
                where.setdefault(b[q], []).append(q)
            for p in range(i, j):
                now = {}
                for q in where.get(a[p], ()):
                    now[q] = run.get(q - 1, 0) + 1
                    if now[q] > best[0]:
                        best = (now[q], p, q)
                run = now
            if not best[0]:
                continue
            n, p, q = best
            anchors = [(p - x, q - x) for x in reversed(range(n))]
        for p, q in anchors:
            todo.append((i, p, k, q))
            out.append((p, q))
            i, k = p + 1, q + 1
        todo.append((i, j, k, m))
    return sorted(out)


def within(found: list[tuple[int, int]], spread: int, need: float) -> list[tuple[int, int]]:
    """The matched places without those far off at the ends, so that they lie within the spread; none if fewer than needed are left."""
    lo, hi = 0, len(found) - 1
    while hi - lo + 1 >= need and found[hi][0] - found[lo][0] >= spread:
        if found[lo + 1][0] - found[lo][0] >= found[hi][0] - found[hi - 1][0]:
            lo += 1
        else:
            hi -= 1
    return found[lo : hi + 1] if hi - lo + 1 >= need else []


class Scanner:
    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, kind, tokens(text)[0]) for name, kind, text in templates]
        self.bags = [Counter(words) for _, _, words in self.templates]
        self.marks = [frozenset(words) - _COMMON for _, _, words in self.templates]
        #: The longest run of words between two marks of a template.
        self.between = [max((len(list(g)) for on, g in groupby(words, marks.__contains__) if not on), default=0) for (_, _, words), marks in zip(self.templates, self.marks)]
        self.vocabulary = frozenset().union(*self.bags) if self.bags else frozenset()

    def scan(self, text: str) -> Iterator[tuple[str, str, float, int, int, int]]:
        """(license, kind, coverage, matched words, first character, end character) of each stretch.

        Where stretches overlap, the template with the most matched words explains them; only equals stay beside it."""
        kept: list[tuple] = []
        explained: dict[int, list[tuple]] = {}  # by place, so that a text with many notices isn't compared with all of them
        for hit in sorted(self.hits(text), key=lambda h: -h[3]):
            cells = range(hit[4] // CELL, (hit[5] - 1) // CELL + 1)
            if all(k[3] == hit[3] or k[5] <= hit[4] or hit[5] <= k[4] for c in cells for k in explained.get(c, ())):
                kept.append(hit)
                for c in cells:
                    explained.setdefault(c, []).append(hit)
        yield from sorted(kept, key=lambda h: (h[4], h[0], h[1]))

    def hits(self, text: str) -> Iterator[tuple[str, str, float, int, int, int]]:
        if not self.vocabulary.intersection(x.lower() for x in _WORD.findall(text)) - _COMMON:
            return
        words, begin, end_of = tokens(text)
        have = self.vocabulary.intersection(words)
        for (name, kind, template), bag, marks, between in zip(self.templates, self.bags, self.marks, self.between):
            need = self.coverage * len(template)
            if sum(n for w, n in bag.items() if w in have) < need:
                continue
            places = [i for i, w in enumerate(words) if w in marks]
            reach = len(template)
            runs: list[list[int]] = []
            for p in places:
                if runs and p - runs[-1][-1] <= 2 + reach + between:
                    runs[-1].append(p)
                else:
                    runs.append([p])
            for r in runs:
                lo, hi = max(0, r[0] - reach // 4 - 4), min(len(words), r[-1] + reach // 4 + 5)
                while hi > lo:
                    # a window holds any stretch of up to twice the template's length that begins in its first half
                    end = min(hi, lo + 4 * reach + 16)
                    stretch = words[lo:end]
                    own = Counter(stretch)
                    found = align(stretch, template) if sum(min(n, own[w]) for w, n in bag.items()) >= need else []
                    found = within(found, 2 * reach + 8, need)
                    if found:
                        first, last = lo + found[0][0], lo + found[-1][0]
                        yield name, kind, len(found) / len(template), len(found), begin[first], end_of[last]
                        lo = last + 1  # the same notice may follow again
                    elif end == hi:
                        break
                    else:
                        lo += 2 * reach + 8


def scanned(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, kind, coverage, matched_words, start_char, end_char): a row for each stretch that covers a template."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(templates, coverage)
        for b in slices(batches):
            rows = [(k, *hit) for k, x in enumerate(texts_of(b, 1)) for hit in own.scan(x)]
            at, *rest = zip(*rows) if rows else [()] * 7
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *map(pa.array, rest, kinds)], names=["id", "license", "kind", "coverage", "matched_words", "start_char", "end_char"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, license string, kind string, coverage double, matched_words long, start_char long, end_char long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
