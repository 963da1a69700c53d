"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates are cut into words; hashes of a few successive words are winnowed (the least of each
few successive ones) into an inverted index. A text's hashes that the index knows name template
and offset; hits on nearby diagonals form a candidate, and a banded local alignment of its
neighbourhood gives the words matched and the span in the text.

A report needs COVERAGE of a template's words, and a score of DENSITY of what its matches give:
each stretch of matches beyond the first costs a gap, so m matches lie in at most
(1 - DENSITY) m + 1 stretches, one of which has a length that follows from m alone. Gram and
window of each template are such that winnowing finds every stretch of that length (gram +
window - 1), and the band is as wide as the gaps that the score allows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: The longest gram; shorter where a template guarantees no stretch as long.
GRAM = 3
#: Diagonals that form one candidate, and words beside it that the alignment may reach into.
NEAR, MARGIN = 8, 4
#: Least share of a template's words that a report needs, and of its matches' score.
COVERAGE, DENSITY = 0.8, 0.7
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -2, -2

#: Public short forms of licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_WORD = re.compile(rb"[0-9a-z]+|[\x80-\xff]+")


def least_run(words: int) -> int:
    """The length of the longest stretch of matches that any reportable alignment of a template of so many words has at least."""
    matched = math.ceil(COVERAGE * words - 1e-9)
    return min(-(-m // (drift(m) + 1)) for m in range(matched, words + 1)) if words else 0


def drift(matched: int) -> int:
    """The gaps (words left out, put in or changed) that the score of so many matches allows."""
    return int((1 - DENSITY) * matched * MATCH / -GAP + 1e-9)


@dataclass(frozen=True)
class Index:
    """Template names, their words by number, and for each length of gram the inverted index of the winnowed ones."""

    names: tuple[str, ...]
    words: dict[bytes, int]
    texts: tuple[np.ndarray, ...]
    postings: dict[int, dict[int, tuple[tuple[int, int], ...]]]

    @classmethod
    def build(cls, templates: dict[str, str] = TEMPLATES) -> Index:
        words: dict[bytes, int] = {}
        texts = [np.array([words.setdefault(w, len(words) + 1) for w in _WORD.findall(t.encode().lower())]) for t in templates.values()]
        postings: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(texts):
            run = least_run(len(ids))
            gram = min(run, GRAM)
            for at, h in winnow(ids, gram, run - gram + 1):
                postings.setdefault(gram, {}).setdefault(h, []).append((t, at))
        return cls(tuple(templates), words, tuple(texts), {g: {h: tuple(p) for h, p in held.items()} for g, held in postings.items()})


def winnow(ids: np.ndarray, gram: int, window: int) -> list[tuple[int, int]]:
    """(place, hash) of the grams kept: in each ``window`` successive ones the least, the last among equals."""
    grams = [_hash(ids[i : i + gram]) for i in range(len(ids) - gram + 1)]
    kept: dict[int, int] = {}
    for lo in range(max(1, len(grams) - window + 1)):
        part = range(lo, min(lo + window, len(grams)))
        if part:
            at = min(part, key=lambda i: (grams[i], -i))
            kept[at] = grams[at]
    return sorted(kept.items())


def _hash(ids: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(ids.astype("<i4").tobytes())


def banded(template: np.ndarray, text: np.ndarray, diagonal: int, half: int) -> np.ndarray:
    """Which words of the text within ``half`` of a diagonal (text place less template place) equal each template word: (words, 2 half + 1)."""
    width = 2 * half + 1
    padded = np.full(len(template) + width - 1, -1, np.int64)
    lo = diagonal - half  # the text place of the first cell
    a, b = max(0, lo), min(len(text), lo + len(padded))
    if a < b:
        padded[a - lo : b - lo] = text[a:b]
    return np.lib.stride_tricks.sliding_window_view(padded, width) == template[:, None]


def align(hits: np.ndarray, size: int, diagonal: int) -> tuple[int, int, int, int, int]:
    """Best local alignment in a band of ``hits`` over a text of ``size`` words: score, matched words, first and last+1 word of
    the text, words of the template spanned. Of equal scores the one of more words, then the one that ends first.

    Cells whose row and column add up alike (2 row + column) depend on earlier ones only, so each
    such wave is worked at once. Score and matched words are one number, ordered as the pair is.
    """
    n, width = hits.shape
    half, unit = width // 2, n + 1
    hit, miss, gap = MATCH * unit + 1, MISMATCH * unit, GAP * unit
    value, start, first = np.zeros(width + 2, np.int64), np.full(width + 2, -1), np.full(width + 2, -1)  # column b is at b + 1
    best = (0, 0, 0, 0, 0)  # value, row, column, start, first
    for wave in range(2 * n - 1 + width):
        lo = max(wave - 2 * (n - 1), 0)
        lo += (wave - lo) % 2
        b = np.arange(lo, min(wave, width - 1) + 1, 2)
        if not b.size:
            continue
        i, c = (wave - b) // 2, b + 1
        j = i + diagonal + b - half
        old, s0, f0 = value[c], start[c], first[c]
        fresh = old % unit == 0
        new, s1, f1 = np.where(fresh, 0, old) + np.where(hits[i, b], hit, miss), np.where(fresh, j, s0), np.where(fresh, i, f0)
        for other in (c + 1, c - 1):  # a template word left out, a text word put in
            moved = np.where(value[other] >= unit, value[other] + gap, np.iinfo(np.int64).min)
            better = moved > new
            new, s1, f1 = np.where(better, moved, new), np.where(better, start[other], s1), np.where(better, first[other], f1)
        none = (new < 0) | (new % unit == 0) | (j < 0) | (j >= size)
        value[c], start[c], first[c] = np.where(none, 0, new), np.where(none, -1, s1), np.where(none, -1, f1)
        top = int(value[c].max())
        if top and top >= best[0]:
            k = int(np.flatnonzero(value[c] == top)[-1])  # the least row of the wave
            if top > best[0] or (int(i[k]), int(b[k])) < best[1:3]:
                best = (top, int(i[k]), int(b[k]), int(s1[k]), int(f1[k]))
    score, matched = divmod(best[0], unit)
    return (score, matched, best[3], best[1] + diagonal + best[2] - half + 1, best[1] + 1 - best[4]) if best[0] else (0, 0, 0, 0, 0)


def scan(index: Index, text: bytes) -> list[tuple[str, int, float, int, int]]:
    """(template, matched words, coverage, first byte, end byte) of each match in a text, by place.

    A candidate on whose diagonals a template stands word for word needs no alignment, nor does
    one whose band holds such a place: nothing in it scores more. Of the others only those are
    aligned in whose band enough words of the template occur near enough to their places.
    """
    lower = text.lower()
    get = index.words.get
    raw = _WORD.findall(lower)
    ids = np.fromiter((get(w, 0) for w in raw), np.int64, len(raw))
    candidates: dict[tuple[int, int], list[int]] = {}
    for gram, held in index.postings.items():
        for place, h in _grams(ids, gram):
            for t, offset in held.get(h, ()):
                candidates.setdefault((t, (place - offset) // NEAR), []).append(place - offset)
    spans, found, whole, rest = None, [], {}, []
    for (t, _), diagonals in sorted(candidates.items()):
        template = index.texts[t]
        here = [d for d in sorted(set(diagonals)) if d >= 0 and np.array_equal(ids[d : d + len(template)], template)]
        whole.setdefault(t, []).extend(here)
        found += [(t, len(template), d, d + len(template)) for d in here]
        if not here:
            rest.append((t, diagonals))
    places = {t: np.array(sorted(d)) for t, d in whole.items()}
    for t, diagonals in rest:
        template, middle = index.texts[t], (min(diagonals) + max(diagonals)) // 2
        half = drift(len(template)) + NEAR // 2 + 1
        if np.searchsorted(places[t], middle - half) < np.searchsorted(places[t], middle + half, side="right"):
            continue
        lo, hi = max(0, middle - MARGIN - half), min(len(ids), middle + len(template) + MARGIN + half)
        hits = banded(template, ids[lo:hi], middle - lo, half)
        if hits.any(axis=1).sum() < COVERAGE * len(template):  # more can't match
            continue
        score, matched, first, end, _ = align(hits, hi - lo, middle - lo)
        if matched >= COVERAGE * len(template) and score >= DENSITY * MATCH * matched:
            found.append((t, matched, lo + first, lo + end))
    if found:
        spans = [m.span() for m in _WORD.finditer(lower)]
    return _distinct([(index.names[t], matched, matched / len(index.texts[t]), spans[a][0], spans[b - 1][1]) for t, matched, a, b in found])


def _grams(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """(place, hash) of the grams of template words; a text's own winnowing could only lose some of them."""
    if len(ids) < gram:
        return []
    whole = np.lib.stride_tricks.sliding_window_view(ids > 0, gram).all(axis=1)
    return [(i, _hash(ids[i : i + gram])) for i in np.flatnonzero(whole).tolist()]


def _distinct(found: list[tuple]) -> list[tuple]:
    """Without matches that lie within a longer one of another or the same template."""
    kept: list[tuple] = []
    for x in sorted(set(found), key=lambda x: (-x[1], x[3], x[0])):
        if not any(y[3] <= x[3] and x[4] <= y[4] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[3], x[4], x[0]))


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each licence notice in ``docs(doc_id, text)``: doc_id, licence, matched_words, coverage,
    start_byte, end_byte (in the UTF-8 text).

    Words are runs of ASCII letters and digits, case aside, or of other characters. A notice is
    reported if COVERAGE of a template's words align, with DENSITY of their score; one inside a
    longer match is not reported apart. Null and empty texts give no rows; repeated rows give repeated rows; other columns
    are ignored. The index is of the templates' size and goes to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index.build(templates))
    names = ["doc_id", "licence", "matched_words", "coverage", "start_byte", "end_byte"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches):
        index = shared.value
        for batch in batches:
            rows = [(i, *x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if text.is_valid for x in scan(index, text.as_py())]
            columns = [*zip(*rows, strict=True)] or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, licence string, matched_words long, coverage double, start_byte long, end_byte long")
