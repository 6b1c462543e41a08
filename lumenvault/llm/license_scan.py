"""License scans by patience alignment.

Text and license template are aligned on words that are unique to both: matches of
such words are put in the order of the template, the longest increasing
subsequence in the text is kept, and the gaps between kept words are aligned the
same way, with words unique within the gap. Equal words at the edges of a gap
count without being unique. Coverage is the share of the template's words that are
aligned. A text has a license if a region of it covers enough of one of its
templates.

Which templates are worth an alignment, and where in the text, comes from the template's least
common words: each must be there, near the others, for the template to reach its
coverage, so regions without enough of them are passed over.

Of templates that share a region the one with the most aligned words, weighed by its
coverage, is told, so a license that says all that another says and a clause more is told apart from it; of equals the
first region, then the first name.

Words are runs of letters, digits, dots and hyphens inside a word, in lower case. A null or empty text
has no words and no license; a text of any length is scanned whole. Repeated rows are scanned one by one; extra columns
are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenvault.llm.common import arrow_map, chunks

# Fixed values: (license, template).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


@dataclass(frozen=True)
class ScanLimits:
    """coverage: least share of the template's words. stretch: a region has at most so many words for each of the template's."""

    coverage: float = 0.8
    stretch: float = 1.5


def words_of(text: str | None) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end) of each word."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]


def increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            ends.append(place)
        else:
            tops[pile], ends[pile] = value, place
    out, place = [], ends[-1] if ends else -1
    while place >= 0:
        out.append(place)
        place = before[place]
    return out[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """(place in text, place in template) of the aligned words, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        unique = [(at[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in at]
        kept = [unique[k] for k in increasing([i for i, _ in unique])]
        if not kept:
            continue
        found += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(found)


def densest_run(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The most pairs in a row whose places in the text lie within reach."""
    low, best = 0, (0, 0, 0)
    for high in range(len(pairs)):
        while pairs[high][0] - pairs[low][0] >= reach:
            low += 1
        best = max(best, (high - low + 1, low, high))
    return pairs[best[1] : best[2] + 1]


def dense_part(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs without those at either end that are fewer than the words of the text that part them from the rest beyond what the template has there."""
    total, start, best = 0, 0, (0, 0, 0)
    for k, (i, j) in enumerate(pairs):
        if k:
            total -= max(0, (i - pairs[k - 1][0]) - (j - pairs[k - 1][1]))
        if total <= 0:
            total, start = 0, k
        total += 1
        best = max(best, (total, -start, k + 1))
    return pairs[-best[1] : best[2]]


class Scanner:
    """Templates, and for each the words without which it can't be covered."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, limits: ScanLimits | None = None):
        self.limits = limits or ScanLimits()
        self.templates = [(name, [w for w, _, _ in words_of(t)]) for name, t in templates]
        spread = Counter(w for _, t in self.templates for w in set(t))
        #: For each template its words, the least common among templates first; of so many with repeats, one must be in any region that covers it.
        self.keys = []
        for _, t in self.templates:
            missing = len(t) - self._needed(t)
            counts, keys, total = Counter(t), [], 0
            for w in sorted(counts, key=lambda w: (spread[w], -len(w), w)):
                keys.append(w)
                total += counts[w]
                if total > missing:
                    break
            self.keys.append(set(keys))
        self.all_keys = set().union(*self.keys) if self.keys else set()

    def _needed(self, template: list[str]) -> int:
        return max(1, -int(-self.limits.coverage * len(template) // 1))

    def region(self, plain: Sequence[str], first: int, last: int, template: Sequence[str], reach: int) -> list[tuple[int, int]]:
        """(place in text, place in template) of the aligned words of a region of at most ``reach`` words within first to last, [] if there is none that covers the template.

        A word of a neighbour may be taken for the template's own and stretch the alignment. Then the densest run of aligned words within
        reach says where the template must lie, and that part is aligned again by itself.
        """
        needed, found = self._needed(template), []
        while True:
            pairs = [(first + i, j) for i, j in align(plain[first:last], template)]
            if len(pairs) < needed:
                return found
            fits = pairs[-1][0] - pairs[0][0] < reach
            if fits:
                found = pairs
            kept = dense_part(pairs if fits else densest_run(pairs, reach))
            if fits and len(kept) < needed:
                return found
            # Where the template would begin and end if all of it stood there, but no further than before.
            a, b = max(first, kept[0][0] - kept[0][1]), min(last, kept[-1][0] + len(template) - kept[-1][1])
            if (a, b) == (first, last) or kept == pairs:
                return found
            first, last = a, b

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, template words, first character, end) of each region that has one; of regions that overlap, those that together have the most aligned words and coverage."""
        low = (text or "").lower()
        if not any(k in low for k in self.all_keys):
            return []
        words = words_of(text)
        plain = [w for w, _, _ in words]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(plain):
            if w in self.all_keys:
                at.setdefault(w, []).append(i)
        found = []
        for (name, template), keys in zip(self.templates, self.keys):
            places = sorted(i for k in keys for i in at.get(k, ()))
            reach, done = int(self.limits.stretch * len(template)) + 1, -1
            for i in places:
                if i < done:
                    continue
                # A region that covers the template has a key; the first of them lies within reach of both its ends.
                first, last = max(0, i - reach, done), min(len(plain), i + reach)
                pairs = self.region(plain, first, last, template, reach)
                if not pairs:
                    continue
                both = [pairs]
                if len(pairs) < len(template):
                    # The neighbour of a like license may have lent it a part: on each side of the widest gap the template may stand whole.
                    k = max(range(1, len(pairs)), key=lambda k: pairs[k][0] - pairs[k - 1][0] - (pairs[k][1] - pairs[k - 1][1]), default=0)
                    both += [r for r in (self.region(plain, first, pairs[k - 1][0] + 1, template, reach), self.region(plain, pairs[k][0], last, template, reach)) if r] if k else []
                for p in both:
                    start, end = p[0][0], p[-1][0] + 1
                    found.append((name, len(p) / len(template), len(template), words[start][1], words[end - 1][2]))
                    done = max(done, end) if p is pairs else done
        # A license that begins where another ends may have been aligned with words of both: it is sought again beside each region.
        edges = {(i, 1) for _, _, _, _, i in found} | {(i, 0) for _, _, _, i, _ in found}
        word_ends, word_starts = [w[2] for w in words], [w[1] for w in words]
        for at_char, after in sorted(edges):
            edge = bisect_right(word_ends, at_char) if after else bisect_left(word_starts, at_char)
            for (name, template), keys in zip(self.templates, self.keys):
                reach = int(self.limits.stretch * len(template)) + 1
                first, last = (edge, min(len(plain), edge + reach)) if after else (max(0, edge - reach), edge)
                if last - first < self._needed(template) or not any(first <= i < last for k in keys for i in at.get(k, ())):
                    continue
                p = self.region(plain, first, last, template, reach)
                if p:
                    found.append((name, len(p) / len(template), len(template), words[p[0][0]][1], words[p[-1][0]][2]))
        return heaviest(found)


def heaviest(regions: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Of regions (license, coverage, template words, start, end) those that don't overlap and weigh most together, in order; the weight is that of the aligned words times the coverage."""
    ordered = sorted(set(regions), key=lambda r: (r[4], r[3], r[0]))
    ends = [r[4] for r in ordered]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for k, (_, coverage, n, start, _) in enumerate(ordered):
        own = best[bisect_right(ends, start, 0, k)][0] + coverage * coverage * n
        best.append((own, 1) if own > best[-1][0] + 1e-9 else (best[-1][0], 0))
    kept, k = [], len(ordered)
    while k:
        if best[k][1]:
            kept.append(ordered[k - 1])
            k = bisect_right(ends, ordered[k - 1][3], 0, k - 1)
        else:
            k -= 1
    return kept[::-1]


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: Sequence[tuple[str, str]] = TEMPLATES, limits: ScanLimits | None = None) -> DataFrame:
    """key, licenses (sorted names), best_license, best_coverage (share of its template), n_regions, and the regions, for every row."""
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["_key"]
    region = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("template_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, limits)
        for part in chunks(batches):
            rows = [[dict(zip(("license", "coverage", "template_words", "start", "end"), r)) for r in scanner.scan(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(region))], ["_key", "regions"])

    found = arrow_map(source, scan, f"_key {kind}, regions array<struct<license: string, coverage: double, template_words: long, start: long, end: long>>")
    best = F.element_at(F.array_sort(F.transform("regions", lambda r: F.struct((-r["template_words"] * r["coverage"]).alias("m"), r["license"].alias("license"), r["coverage"].alias("coverage")))), 1)
    best = F.when(F.size("regions") > 0, best)
    names = F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["license"])))
    return found.select(F.col("_key").alias(key), F.array_join(names, ",").alias("licenses"), best["license"].alias("best_license"), F.round(best["coverage"], 6).alias("best_coverage"), F.size("regions").cast("long").alias("n_regions"), "regions")
