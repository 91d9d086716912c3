"""License scan by patience alignment of text words with license templates.

Words unique to both sides anchor the alignment, the longest increasing subsequence keeps the anchors that
agree in order, and the gaps between them are aligned the same way. Coverage is the share of the template's
words that were aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
#: Cells of a plain alignment; a larger gap without unique words is halved first, in linear space.
GAP_CELLS = 40_000

#: Public license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def increasing(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) that also increases in the second: patience piles."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before[n] = last[at - 1] if at else -1
        tops[at : at + 1] = [b]
        last[at : at + 1] = [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _plain(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of a small gap."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and each beginning of ``b``, in one row."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row


def _halved(a: list[str], b: list[str]) -> tuple[int, int]:
    """Where a longest common subsequence can be cut: the middle of ``a`` and its place in ``b``."""
    half = len(a) // 2
    left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
    return half, max(range(len(b) + 1), key=lambda j: left[j] + right[j])


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned (position in a, position in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        if not anchors:
            if in_a.keys().isdisjoint(in_b):
                continue
            if (a1 - a0) * (b1 - b0) <= GAP_CELLS:
                out += [(a0 + i, b0 + j) for i, j in _plain(a[a0:a1], b[b0:b1])]
            elif a1 - a0 > 1:
                i, j = _halved(a[a0:a1], b[b0:b1])
                todo += [(a0, a0 + i, b0, b0 + j), (a0 + i, a1, b0 + j, b1)]
            else:
                out.append((a0, b0 + b[b0:b1].index(a[a0])))
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(i + 1, k, j + 1, l) for (i, j), (k, l) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Templates:
    """Templates as words, each with key words: so many of its longest that a text without any of them lacks more of the
    template than ``coverage`` allows. Only what stands round a key word has to be aligned, and nothing is lost."""

    def __init__(self, texts: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.words = {k: words_of(t)[0] for k, t in texts.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.keys = {k: self._keys(counts, coverage * counts.total()) for k, counts in self.counts.items()}
        self.any_key = sorted(set().union(*self.keys.values()))

    @staticmethod
    def _keys(counts: Counter[str], least: float) -> frozenset[str]:
        left, keys = counts.total(), []
        for word in sorted(counts, key=lambda w: (-len(w), w)):
            if left < least:
                break
            keys.append(word)
            left -= counts[word]
        return frozenset(keys)


def _windows(words: list[str], reach: int, keys: frozenset[str]) -> list[tuple[int, int]]:
    """Stretches of words around key words, a template's length to both sides."""
    return [(max(0, i - reach), min(len(words), i + reach + 1)) for i, w in enumerate(words) if w in keys]


def scan_text(text: str, templates: Templates) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of non-overlapping finds; more aligned words win, then the smaller name."""
    low = text.lower()
    if not any(k in low for k in templates.any_key):
        return []
    words, spans = words_of(text)
    present = set(words)
    found: set[tuple[int, str, int, int]] = set()
    for name, template in templates.words.items():
        if present.isdisjoint(templates.keys[name]):
            continue
        least, counts = templates.coverage * len(template), templates.counts[name]
        for lo, hi in dict.fromkeys(_windows(words, len(template), templates.keys[name])):
            todo = [(lo, hi)]
            while todo:  # what stands left and right of a find may hold another copy
                a, b = todo.pop()
                part = words[a:b]
                if sum(min(n, counts[w]) for w, n in Counter(part).items() if w in counts) < least:
                    continue
                pairs = patience(part, template)
                if len(pairs) < least:
                    continue
                s, e = a + pairs[0][0], a + pairs[-1][0] + 1
                found.add((len(pairs), name, s, e))
                todo += [x for x in ((a, s), (e, b)) if x != (a, b)]
    kept: list[tuple[str, float, int, int]] = []
    taken: list[tuple[int, int]] = []
    for n, name, s, e in sorted(found, key=lambda x: (-x[0], x[3] - x[2], x[1], x[2])):
        if all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            kept.append((name, n / len(templates.words[name]), spans[s][0], spans[e - 1][1]))
    return sorted(kept, key=lambda x: x[2])


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start, end): a row for each license notice in each whole text.

    Null and empty texts have none; repeated rows give repeated results; other columns are not read. start and
    end are code points, end exclusive. One scan and one Arrow map, no shuffle.
    """
    texts = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = Templates(texts, coverage)
        for batch in batches:
            rows = [(key, *hit) for key, text in zip(batch["doc_id"], batch["text"], strict=True) for hit in scan_text(text or "", ready)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start", "end"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(scan, "doc_id long, license string, coverage double, start long, end long")
