"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts are runs of ASCII letters and digits, lower-cased. Of every window of consecutive word k-grams the
smallest hash is a fingerprint, so that a run of GRAM + WINDOW - 1 words in common always shares one. An inverted index
from fingerprints to places in templates proposes diagonals; along them a banded local alignment reports how much of
the template is there and where.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ChunkCache, small_batches, text_groups, tool

WORD = re.compile(r"[A-Za-z0-9]+")
#: Words of a fingerprinted run, and runs of a window of which the smallest is kept.
GRAM, WINDOW = 3, 2
#: Half width of the band, and what matches, mismatches and gaps add to the score of an alignment.
BAND, MATCH, MISMATCH, GAP = 8, 2, -1, -1

#: Templates of fewer words must be there in full, and nothing else between them.
SHORT = 20
#: Share of a template's fingerprints that must lie in a band before the band is aligned.
VOTE = 0.1

# Public notices and license texts that are looked for by default.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    'distribution.{} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _BSD.format(""),
    "bsd-3-clause": _BSD.format(
        " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        'copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
# Notices of the GNU licenses by name and version, with and without later versions.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by "
    "the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
_GNU_ONLY = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} version {1} as "
    "published by the Free Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT "
    "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} "
    "for more details."
)
_GNU_NAMES = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
_GNU_VERSIONS = (("gpl", "2.0", "2"), ("gpl", "3.0", "3"), ("lgpl", "2.1", "2.1"), ("lgpl", "3.0", "3"), ("agpl", "3.0", "3"))
for _k, _v, _shown in _GNU_VERSIONS:
    TEMPLATES |= {
        f"{_k}-{_v}-header": _GNU.format(_GNU_NAMES[_k], _shown),
        f"{_k}-{_v}-only-header": _GNU_ONLY.format(_GNU_NAMES[_k], _shown),
        f"{_k}-{_v}-notice": f"This work is licensed under the GNU {_GNU_NAMES[_k]}, version {_shown}.",
    }
TEMPLATES["lgpl-2.0-header"] = _GNU.format("Library General Public License", "2")
# Notices of other licenses of which there are several.
TEMPLATES |= {
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "epl-1.0-header": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
    ),
}
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for _k, _name in _CC.items():
    TEMPLATES |= {f"cc-{_k}-4.0-notice": f"Licensed under CC {_k.upper()} 4.0.", f"cc-{_k}-4.0": f"This work is licensed under a Creative Commons {_name} 4.0 International License."}
# Machine-readable tags, which a notice may consist of.
_TAGS = ["Apache-2.0", "MIT", "MIT-0", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC", "Zlib", "Unlicense"]
_TAGS += [f"{k.upper()}-{v}{end}" for k, v, _ in _GNU_VERSIONS for end in ("", "-only", "-or-later")] + [f"CC-{k.upper()}-4.0" for k in _CC]
TEMPLATES |= {f"spdx-{k}": f"SPDX-License-Identifier: {k}" for k in _TAGS}
#: Words, or pairs of them, that tell a longer notice from its relatives, in groups of which one stands for the others: the
#: text must have one of a group exactly if the template has.
DECIDING = ("gnu general", "gnu lesser", "gnu affero", "gnu library", "later|option|either", "1", "2", "3", "mozilla", "eclipse", "v1")
#: Names of templates to which they apply.
RELATED = re.compile(r"(a|l)?gpl-.*-header|(m|e)pl-.*-header")
#: Whole public license texts, a file for each.
TEXTS = Path(__file__).with_name("license_texts")


def default_templates() -> dict[str, str]:
    """TEMPLATES and the texts of the folder TEXTS, by name."""
    return TEMPLATES | {p.name.lower(): p.read_text() for p in sorted(TEXTS.iterdir())}


def _hash(words: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w.lower()) for w in words]


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words; of a shorter text, of the whole text."""
    n = max(1, len(h) - GRAM + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(GRAM, len(h))):
        out += h[i : i + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x5851F42D4C957F2D & (1 << 64) - 1 | 1)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def winnow(g: np.ndarray) -> np.ndarray:
    """Places whose hash is the smallest of some window of WINDOW consecutive runs (of all runs, if there are fewer)."""
    w = min(WINDOW, len(g))
    if w <= 1:
        return np.arange(len(g))
    low = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1)
    on = np.zeros(len(g), bool)
    for i in range(w):
        on[i : i + len(low)] |= g[i : i + len(low)] == low
    return np.flatnonzero(on)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int]:
    """Banded local alignment; template word i may meet text word j where abs(j - i - shift) <= band. Returns score, number
    of matched words, and the first and one past the last matched word of the text of the best alignment; ties go to the
    earlier end."""
    width, low = 2 * band + 1, -(10**9)
    t, x = template.tolist(), text.tolist()
    # A cell: score, matches, first matched word.
    before: list[tuple[int, int, int]] = [(0, 0, -1)] * width
    best = (0, 0, 0, 0)
    for i in range(len(t)):
        here: list[tuple[int, int, int]] = []
        for c in range(width):
            j = i + shift + c - band
            if j < 0 or j >= len(x):
                here.append((0, 0, -1))
                continue
            s, m, f = before[c]
            if t[i] == x[j]:
                cell = (s + MATCH, m + 1, f if f >= 0 else j)
            else:
                cell = (s + MISMATCH, m, f)
            up = before[c + 1] if c + 1 < width else (low, 0, -1)
            left = here[c - 1] if c else (low, 0, -1)
            if up[0] + GAP > cell[0]:
                cell = (up[0] + GAP, up[1], up[2])
            if left[0] + GAP > cell[0]:
                cell = (left[0] + GAP, left[1], left[2])
            if cell[0] <= 0:
                cell = (0, 0, -1)
            elif cell[0] > best[0] and t[i] == x[j]:
                best = (cell[0], cell[1], cell[2], j + 1)
            here.append(cell)
        before = here
    return best


class Scanner:
    """Templates with their inverted index."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names, self.coverage = list(templates), coverage
        self.words = [np.array(_hash(WORD.findall(templates[k])), np.uint64) for k in self.names]
        index: dict[int, list[tuple[int, int]]] = {}
        for k, h in enumerate(self.words):
            g = grams(h)
            for at in winnow(g).tolist():
                index.setdefault(int(g[at]), []).append((k, at))
        self.index = index
        self.asked = [[tuple(_hash(phrase.split())) for phrase in group.split("|")] for group in DECIDING]
        self.deciding = [self.named(h) if RELATED.fullmatch(k) else None for k, h in zip(self.names, self.words, strict=True)]
        self.least = [max(1, int(VOTE * len(set(winnow(grams(h)).tolist())))) if len(h) >= SHORT else 1 for h in self.words]
        self.prints = np.array(sorted(index), np.uint64)
        self.known = ChunkCache(_hash, 500_000)

    def scan(self, texts: list[str | None]) -> Iterable[list[tuple]]:
        """For each text its matches: template, start and end (characters), matched words, words of the template, words
        between start and end."""
        lists = [WORD.findall(t) if t else [] for t in texts]
        self.known.learn(lists)
        get = self.known.__getitem__
        for text, found in zip(texts, lists, strict=True):
            if not found or not len(self.prints):
                yield []
                continue
            h = np.fromiter(map(get, found), np.uint64, len(found))
            g = grams(h)
            at = winnow(g)
            near = np.minimum(np.searchsorted(self.prints, g[at]), len(self.prints) - 1)
            at = at[self.prints[near] == g[at]]
            yield self.matches(text, h, g, at.tolist()) if len(at) else []

    def named(self, span: np.ndarray) -> list[bool]:
        """Which groups of deciding words a stretch of words has."""
        held = span.tolist()
        words, pairs = set(held), set(zip(held, held[1:]))  # noqa: B905
        return [any(p in pairs if len(p) == 2 else p[0] in words for p in group) for group in self.asked]

    def matches(self, text: str, h: np.ndarray, g: np.ndarray, at: list[int]) -> list[tuple]:
        by: dict[int, list[tuple[int, int]]] = {}
        for j in at:
            for k, i in self.index[int(g[j])]:
                by.setdefault(k, []).append((j, i))
        found = []
        for k, hits in by.items():
            n = len(self.words[k])
            band = max(1, min(BAND, n // 4))
            # Diagonals that lie close together, as insertions and deletions leave them, share one band.
            near: list[list[int]] = []
            for shift, votes in sorted(Counter(j - i for j, i in hits).items()):
                if near and shift - near[-1][1] <= 2 * band and shift - near[-1][0] <= 4 * band:
                    near[-1][1] = shift
                    near[-1][2] += votes
                else:
                    near.append([shift, shift, votes])
            for low, high, votes in near:
                if votes < self.least[k]:
                    continue
                a, b = max(0, low - band), min(len(h), high + n + band + 1)
                _, m, first, stop = align(self.words[k], h[a:b], (low + high) // 2 - a, band + (high - low + 1) // 2)
                if n < SHORT and (m < n or stop - first > n):
                    continue
                if m >= self.coverage * n and (self.deciding[k] is None or self.deciding[k] == self.named(h[a + first : a + stop])):
                    found.append((m, m / n, k, a + first, a + stop))
        # Of matches that overlap, the one with the most words of its template stands.
        found.sort(key=lambda x: (-x[0], -x[1], x[3], x[2]))
        kept: list[tuple] = []
        for x in found:
            if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
                kept.append(x)
        if not kept:
            return []
        spans = [x.span() for x in WORD.finditer(text)]
        return [(self.names[k], spans[first][0], spans[stop - 1][1], m, len(self.words[k]), stop - first) for m, _, k, first, stop in sorted(kept, key=lambda x: x[3])]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.75) -> DataFrame:
    """Places of texts that match a license template: id, template, start_char, end_char (code points, end exclusive),
    matched_words, template_words, coverage (matched share of the template's words) and text_coverage (matched share of the
    words between the match's ends), for alignments with at least that `coverage`. A template of fewer than SHORT words must
    be there whole and without a word between its own, as one word may be another license's name or version; of the longer
    notices of licenses that differ by such words alone (RELATED), the DECIDING ones must agree. Several for a text if there are several, none for null, empty or clean texts. Of matches that
    overlap, whatever their templates, the one with the most matched words stands. Null ids stay; repeated rows are scanned as often as
    they stand; other columns, whatever their names, are not read; an empty table gives an empty result. A narrow pass
    without shuffle; the index of the templates goes to every task and does not grow with the texts. A band is aligned only if a share VOTE
    of the template's fingerprints lies in it, so that words that licenses have in common cost no alignment. Texts of any
    length are scanned whole, a very long one alone. Templates of fewer
    than GRAM + WINDOW - 1 words are found only where they share a fingerprint.
    """
    wanted = dict(default_templates() if templates is None else templates)
    small_batches(docs.sparkSession)

    def run(batches):
        scanner = tool(("licenses", tuple(wanted.items()), coverage), lambda: Scanner(wanted, coverage))
        for part, texts in text_groups(batches):
            ids = part.column(0).to_pylist()
            rows = [(i, *m[:5], m[3] / m[4], m[3] / m[5]) for i, found in zip(ids, scanner.scan(texts), strict=True) for m in found]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "template", "start_char", "end_char", "matched_words", "template_words", "coverage", "text_coverage"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "id long, template string, start_char long, end_char long, matched_words long, template_words long, coverage double, text_coverage double").withColumnRenamed("id", id_col)
