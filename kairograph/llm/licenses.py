"""License scans: winnowed fingerprints, an inverted index, banded alignment.

Templates are cut into grams of ``GRAM`` words; of every ``WINNOW`` neighbouring
hashes the smallest is a fingerprint (templates with fewer grams keep all), posted
in an inverted index with template and place.  A document's grams are looked up;
hits of one template that follow each other in both are chained, with no more than
a template's length of other words between two of them, and the template is
aligned with the chain's stretch inside a band that holds its diagonals and
``BAND`` on either side.  Reported are the matched share of the template's words
and the characters they span, where ``COVERAGE`` of the template is matched, or
``QUOTED`` of it and ``QUOTED_WORDS`` words: parts and edited texts are matches of
lower coverage.

The index holds the templates alone and is sent to all tasks; templates are a
parameter of bounded size (more than ``MAX_TEMPLATE_WORDS`` words are refused).
Null texts have no matches.  Rows are scanned one by one, whole; time and memory go
with a text's words and hits.  Of overlapping matches the one with more matched
words stays, then the one with the larger share, then the first by name.
"""

from __future__ import annotations

import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import id_text, map_arrow

GRAM, WINNOW, BAND, COVERAGE = 3, 4, 6, 0.8
QUOTED, QUOTED_WORDS = 0.3, 20
#: Cost of a text word passed over, in matches.
GAP = 0.02
MAX_TEMPLATE_WORDS = 1_000_000

#: Wordings of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

_WORD = re.compile(r"[^\W_]+")
Match = tuple[str, float, int, int]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def winnow(hashes: list[int], window: int = WINNOW) -> list[int]:
    """Places of the smallest hash of every window, the last of equals; all places if there is no full window."""
    if len(hashes) < window:
        return list(range(len(hashes)))
    return sorted({max((i for i in range(s, s + window)), key=lambda i: (-hashes[i], i)) for s in range(len(hashes) - window + 1)})


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[float, int, int, int]:
    """Most template words matched in order by ``text`` on diagonals (text place less template place) from ``low`` to ``high``.

    Returns the score, that number, and the first and last text word matched.  A template word
    passed over costs a quarter of a match, a text word passed over ``GAP``, so
    spans stay tight and insertions are bridged.
    """
    width = high - low + 1
    nothing = (0.0, 0, -1, -1)
    best = [nothing] * (width + 1)  # by diagonal: score, matched, first, last
    top = nothing
    for i, word in enumerate(template):
        row = [nothing] * (width + 1)
        left = nothing
        for d in range(width):
            j = low + d + i
            if j < 0:
                continue
            if j >= len(text):
                break
            score, matched, first, last = best[d]  # one word on in both
            here = (score + 1, matched + 1, first if matched else j, j) if text[j] == word else (score - 0.25, matched, first, last)
            up = best[d + 1]  # a template word passed over
            if up[0] - 0.25 > here[0]:
                here = (up[0] - 0.25, *up[1:])
            if left[0] - GAP > here[0]:
                here = (left[0] - GAP, *left[1:])
            if here[0] <= 0:
                here = nothing
            row[d] = left = here
            if here[0] > top[0]:
                top = here
        best = row
    return top


class Scanner:
    """The inverted index of a set of templates."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage, self.names = coverage, sorted(templates)
        self.ids: dict[str, int] = {}
        self.texts = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words(templates[n])] for n in self.names]
        if sum(map(len, self.texts)) > MAX_TEMPLATE_WORDS:
            raise ValueError("too many template words to send to all tasks")
        self.index: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.need = []
        for t, ids in enumerate(self.texts):
            size = min(GRAM, len(ids))
            grams = [tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)] if ids else []
            places = winnow([hash(g) for g in grams])
            for i in places:
                self.index.setdefault(grams[i], []).append((t, i))
            self.need.append(max(1, len(places) // 5))
        self.sizes = sorted({len(g) for g in self.index})

    def enough(self, t: int, matched: int) -> bool:
        """Whether so many matched words of a template are a match."""
        n = len(self.texts[t])
        return matched >= self.coverage * n or (matched >= QUOTED_WORDS and matched >= QUOTED * n)

    def candidates(self, ids: list[int]) -> list[tuple[int, list[tuple[int, int]]]]:
        """Template and chained hits ``(template place, text place)`` of every chain with enough of them."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for size in self.sizes:
            for j in range(len(ids) - size + 1):
                if ids[j] and (found := self.index.get(tuple(ids[j : j + size]))):
                    for t, i in found:
                        hits.setdefault(t, []).append((i, j))
        out = []
        for t, pairs in hits.items():
            far, chains = len(self.texts[t]), []
            for i, j in sorted(pairs, key=lambda x: (x[1], x[0])):
                chains, ended = [c for c in chains if j - c[-1][1] <= far], [c for c in chains if j - c[-1][1] > far]
                out += [(t, c) for c in ended if len(c) >= self.need[t]]
                fitting = [c for c in chains if c[-1][0] < i and c[-1][1] < j]
                if fitting:
                    min(fitting, key=lambda c: abs((j - i) - (c[-1][1] - c[-1][0]))).append((i, j))
                else:
                    chains.append([(i, j)])
            out += [(t, c) for c in chains if len(c) >= self.need[t]]
        return out

    def scan(self, text: str | None) -> list[Match]:
        """``(template, coverage, start, end)`` in characters, by start."""
        if not text:
            return []
        known, low = self.ids, text.lower()
        ids = [known.get(w, 0) for w in _WORD.findall(low)]
        made: dict[tuple[int, int, int], int] = {}
        for t, chain in self.candidates(ids):
            diagonals, band = [j - i for i, j in chain], min(BAND, len(self.texts[t]) // 2)  # narrower than the next copy of a short template
            _, matched, first, last = align(self.texts[t], ids, min(diagonals) - band, max(diagonals) + band)
            if self.enough(t, matched):
                made[t, first, last] = matched
        if not made:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        kept: list[tuple[int, int, int, int]] = []  # first, last, template, matched; apart and in order
        for (t, first, last), matched in sorted(made.items(), key=lambda x: (-x[1], -x[1] / len(self.texts[x[0][0]]), x[0])):
            at = bisect(kept, (first, last, t, matched))
            if (at == 0 or kept[at - 1][1] < first) and (at == len(kept) or kept[at][0] > last):
                kept.insert(at, (first, last, t, matched))
        return [(self.names[t], matched / len(self.texts[t]), spans[a][0], spans[b][1]) for a, b, t, matched in kept]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, matches array<struct<license,coverage,start,end>>`` of every row."""
    chosen = dict(templates or TEMPLATES)
    src = id_text(docs)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        scanner = Scanner(chosen, coverage)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[{"license": n, "coverage": c, "start": a, "end": b} for n, c, a, b in scanner.scan(t)] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "matches"])

        return step

    return map_arrow(src, make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, matches array<struct<license:string,coverage:double,start:int,end:int>>")


def license_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_matches, licenses, best_coverage, spans`` of every document."""
    shown = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return license_matches(docs).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("matches.coverage")), F.lit(0.0)).alias("best_coverage"),
        shown.alias("spans"),
    )
