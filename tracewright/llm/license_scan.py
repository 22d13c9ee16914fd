"""License texts in documents: winnowed fingerprints pick candidates, banded alignment settles them.

The templates are a small fixed list, so their inverted index (fingerprint to template and place) travels with the plan; the
documents are scanned where they are read. Fingerprints are hashes of GRAM words, of which the least of each WINNOW in a
row is kept for a template; every gram of a document is looked up, so a shared run of GRAM + WINNOW - 1 words is always
seen. Around each group of hits on neighbouring diagonals the template is aligned with the text in a band.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.textkernels import ASCII_LOWER, chunks, rolling, texts_of, words_of

GRAM, WINNOW, BAND = 3, 2, 8
#: Least share of a template's words that a span has to match.
COVERAGE = 0.8

# Whole license texts in their public wording, without the line of the copyright holder.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT = _MIT_GRANT + """
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC = _ISC_GRANT + """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
# End of fixed values.

#: Notices and whole texts by SPDX identifier, in the public wording of each license. The sentence that both BSD licenses begin with stands for the commoner one.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        _MIT_GRANT,
        _MIT,
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD-2-Clause": (_BSD_GRANT + _BSD_TWO + _BSD_END,),
    "BSD-3-Clause": (_BSD_GRANT, _BSD_GRANT + _BSD_TWO + _BSD_THREE + _BSD_END),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "ISC": (_ISC_GRANT, _ISC),
    "Zlib": (_ZLIB,),
}

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each `window` in a row, the last one where equal."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(1))


class TemplateIndex:
    def __init__(self, templates: Mapping[str, tuple[str, ...]]):
        self.names = [name for name, texts in templates.items() for _ in texts]
        raw = [ASCII_LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes() for texts in templates.values() for t in texts]
        words = [words_of([t], _GAP).hashes() for t in raw]
        self.words = [w.tolist() for w in words]
        prints, owner, place = [], [], []
        for k, w in enumerate(words):
            grams = rolling(w, GRAM, 0x1B873593CC9E2D51)
            at = winnow(grams, WINNOW)
            prints.append(grams[at])
            owner.append(np.full(len(at), k))
            place.append(at)
        order = np.argsort(np.concatenate(prints), kind="stable")
        self.prints, self.owner, self.place = np.concatenate(prints)[order], np.concatenate(owner)[order], np.concatenate(place)[order]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in grams, template, place in it) of every gram that is a fingerprint."""
        lo, hi = np.searchsorted(self.prints, grams, "left"), np.searchsorted(self.prints, grams, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(grams)), n)
        of = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, self.owner[of], self.place[of]


def aligned(template: list[int], text: list[int], diagonal: int, spread: int) -> tuple[int, int, int]:
    """(matched words, first and end word of the text) of the best local alignment near a diagonal.

    A match counts 2, a mismatch or a gap -1; cells further from the diagonal than `spread` are not visited.
    """
    best = (0, 0, 0, 0)
    row: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        new: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - spread), min(len(text), i + diagonal + spread + 1)):
            score, matched, start = row.get(j - 1, (0, 0, j))
            if score == 0:
                matched, start = 0, j
            if word == text[j]:
                cell = (score + 2, matched + 1, start)
            else:
                cell = max((score - 1, matched, start), _gap(row.get(j)), _gap(new.get(j - 1)), (0, 0, j))
            new[j] = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        row = new
    return best[1], best[2], best[3]


def _gap(cell: tuple[int, int, int] | None) -> tuple[int, int, int]:
    return (cell[0] - 1, cell[1], cell[2]) if cell else (0, 0, 0)


def spans_of(index: TemplateIndex, words: np.ndarray, grams: np.ndarray, coverage: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end word) of a document, the best of those that overlap, in order."""
    at, owner, place = index.hits(grams)
    line = at - place
    order = np.lexsort((at, line, owner)).tolist()
    at, line, owner = at.tolist(), line.tolist(), owner.tolist()
    found = []
    k = 0
    while k < len(order):
        first = last = order[k]
        j = k + 1
        # Hits of one template on diagonals within the band of the last one and within its length are one candidate.
        while j < len(order) and owner[order[j]] == owner[first] and line[order[j]] - line[last] <= BAND and abs(at[order[j]] - at[first]) <= len(index.words[owner[first]]) + BAND:
            last = order[j]
            j += 1
        template = index.words[owner[first]]
        low, high = line[first], line[last]
        begin = max(0, low - BAND)
        part = words[begin : high + len(template) + BAND].tolist()
        # A short notice may stand there several times: before and after each span the rest of the part is aligned again.
        rests = [(0, len(part))]
        while rests:
            a, b = rests.pop()
            if b - a < coverage * len(template):
                continue
            matched, start, end = aligned(template, part[a:b], (low + high) // 2 - begin - a, BAND + (high - low + 1) // 2)
            if matched and matched >= coverage * len(template):
                found.append((matched, len(template), owner[first], begin + a + start, begin + a + end))
                rests += [(a, a + start), (a + end, b)]
        k = j
    found.sort(key=lambda f: (-f[0], -f[0] / f[1], f[2], f[3]))
    kept: list[tuple[int, int, tuple]] = []  # apart from each other, in order
    for f in found:
        k = bisect_left(kept, (f[3], f[4]))
        if (k == 0 or kept[k - 1][1] <= f[3]) and (k == len(kept) or f[4] <= kept[k][0]):
            kept.insert(k, (f[3], f[4], f))
    return [(index.names[f[2]], f[0] / f[1], f[3], f[4]) for _, _, f in kept]


_SPANS = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(index: TemplateIndex, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for i, j in chunks(texts):
                w = words_of(texts[i:j], _GAP)
                hashes = w.hashes(lower=True)
                grams = rolling(hashes, GRAM, 0x1B873593CC9E2D51)
                hit = np.zeros(len(w.starts) + 1, np.int64)
                hit[1 : len(grams) + 1] = np.isin(grams, index.prints)
                hit = np.cumsum(hit)
                rows = []
                for k in range(j - i):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    spans = spans_of(index, hashes[a:b], grams[a : b - GRAM + 1], coverage) if b - a >= GRAM and hit[b - GRAM + 1] > hit[a] else []
                    out = []
                    if spans:  # code points before each byte
                        points = np.append(0, np.cumsum((w.buf[w.bounds[k] : w.bounds[k + 1]] & 0xC0) != 0x80))
                    for name, share, start, end in spans:
                        lo, hi = w.starts[a + start] - w.bounds[k], w.ends[a + end - 1] - w.bounds[k]
                        out.append({"license": name, "coverage": share, "start": int(points[lo]), "end": int(points[hi])})
                    rows.append(out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and spans (license, coverage, start, end in code points of the text) of each document.

    docs needs doc_id and text; other columns are ignored. templates: a list of bounded size that travels with the plan; words are
    runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. Of spans that overlap, the one with
    more matched words stays. Null, empty and word-less texts have no spans. Repeated rows get equal results.
    An empty table gives an empty result.
    """
    pairs = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return pairs.mapInArrow(_scanned(TemplateIndex(templates), coverage), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<license: string, coverage: double, start: long, end: long>>")
