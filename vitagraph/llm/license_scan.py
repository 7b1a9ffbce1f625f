"""License scans: winnowed template fingerprints pick candidates, banded alignment verifies them.

Each template is a sequence of normalised words.  The hashes of its runs of ``K`` words
are winnowed: of every ``WINDOW`` neighbouring runs the one with the least hash is kept, so
any passage of ``K + WINDOW - 1`` words that a text shares with a template holds a kept run.
The kept runs form an inverted index (hash to template and place), which is bounded by the
templates and sent along with the code.  All runs of every text are looked up in it; each
hit proposes a template and a diagonal (place in the text minus place in the template).
Hits on nearby diagonals are merged, and the words around them are aligned with the
template in a band of ``BAND`` words to either side of all of them.  Of equally good alignments
the one closest to these diagonals counts, so that neighbouring copies keep their own words.  A match is complete when the aligned
equal words cover at least ``MIN_COVERAGE`` of the template.  Where the whole template does
not match so well, the passages that do are matches too, partial ones: neighbouring hits (at
most ``GAP`` words apart) are aligned by themselves, and a passage counts from
``K + WINDOW - 1`` equal words, which winnowing is sure to find.  Coverage is always of the
whole template.

Licences of one family differ in few words.  A match that lacks a name or version number of its
template, or has a word such as "Lesser" between its own, is of another licence and is dropped.

Short licences stand here as their opening and as their whole text ("... text"); Apache-2.0,
GPL-3.0, MPL-2.0 and the CC ones only as the notices that they ask files to bear.

Words are lower-cased (A-Z) and stripped of punctuation at both ends, so wrapped and
re-punctuated copies align.  Spans are in code points of the original text.

Edge cases: null, empty and wordless texts have no match; matches of one template in a
text don't overlap (better covered ones win, then earlier ones); repeated rows each report
their matches; a null doc_id stays null; only doc_id and text are read; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_map
from .shingles import WordHashes, runs

K = 3
WINDOW = 3
BAND = 6
MIN_COVERAGE = 0.8
GAP = 16
#: Words that tell licences of a family apart: names, and what follows these words if it is a number.
NAMES = (b"mit", b"apache", b"gnu", b"mozilla", b"attribution", b"attribution-sharealike")
BEFORE_VERSION = (b"version", b"v", b"attribution", b"attribution-sharealike")
#: Words that, within a notice, make it another licence's.
OTHERS = (b"lesser", b"library", b"affero", b"noncommercial", b"noderivatives", b"sharealike")
STRIP = b".,;:!?\"'()[]{}<>*#/-_&%$|"

_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_2 = (
    " Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
    " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_LIABLE = (
    " WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,"
    " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
)
_DEALINGS = (
    " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING"
    " FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Notices, opening passages and short whole texts of well-known licences.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    ' associated documentation files (the "Software"), to deal in the Software without restriction, including'
    " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
    " following conditions",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except'
    " in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
    " (at your option) any later version.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
    " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TEMPLATES |= {
    "MIT text": TEMPLATES["MIT"] + ": The above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the Software." + _AS_IS + "," + _LIABLE + " AUTHORS OR COPYRIGHT HOLDERS" + _DEALINGS,
    "BSD-2-Clause text": _BSD_2 + _BSD_END,
    "BSD-3-Clause text": _BSD_2 + _BSD_3 + _BSD_END,
    "ISC text": TEMPLATES["ISC"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS'
    " SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR"
    " ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
    " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH"
    " THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense text": TEMPLATES["Unlicense"] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this"
    " software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any"
    " means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all"
    " copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large"
    " and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in"
    " perpetuity of all present and future rights to this software under copyright law." + _AS_IS + "," + _LIABLE + " AUTHORS"
    + _DEALINGS + " For more information, please refer to <https://unlicense.org>",
    "Apache-2.0 full notice": TEMPLATES["Apache-2.0"] + " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law"
    ' or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR'
    " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
    " limitations under the License.",
    "GPL-3.0 full notice": TEMPLATES["GPL-3.0"] + " This program is distributed in the hope that it will be useful, but WITHOUT ANY"
    " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General"
    " Public License for more details. You should have received a copy of the GNU General Public License along with this"
    " program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0 full notice": TEMPLATES["MPL-2.0"] + " If a copy of the MPL was not distributed with this file, You can obtain one at"
    " https://mozilla.org/MPL/2.0/.",
}


def normal(word: bytes) -> bytes:
    return word.strip(STRIP) or word


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the runs that are kept: the least hash, the last of equals, of each window."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())] if len(hashes) else [], int)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], WINDOW)
    picks = views.argmin(axis=1) + np.arange(len(views))
    return np.unique(len(hashes) - 1 - picks)


def align(text: np.ndarray, template: np.ndarray, shift: int, upto: int | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Most equal words in order, with text places near template place + ``shift`` (to ``upto``).

    Returns their number and their (template, text) places.  Plain dynamic programming over the
    band; a cell holds (equal words, less how far off the first and the last of them are).
    """
    upto = shift if upto is None else upto
    middle, none = (shift + upto) // 2, (0, 0, 0)
    low, width = shift - BAND, upto - shift + 2 * BAND + 1
    table = [[none] * (width + 1)]
    for i in range(len(template)):
        above, row = table[-1], [none] * (width + 1)
        for c in range(width):
            j = i + low + c
            best = max(above[c + 1], row[c - 1] if c else none)  # skip the template word, or the text word
            if 0 <= j < len(text) and text[j] == template[i]:
                off = -abs(j - i - middle)
                n, first, _ = above[c]
                best = max(best, (n + 1, first if n else off, off))
            row[c] = best
        table.append(row)
    best = max(table[-1])
    c, path = table[-1].index(best), []
    for i in range(len(template) - 1, -1, -1):
        while c and table[i + 1][c] == table[i + 1][c - 1] and table[i + 1][c] != table[i][c + 1]:
            c -= 1
        if table[i + 1][c][0] == 0:
            break
        if table[i + 1][c] == table[i][c + 1]:
            c += 1  # the same place in the text, one template word before
        else:
            path.append((i, i + low + c))
    return best[0], path[::-1]


class Index:
    """Inverted index over the winnowed templates."""

    def __init__(self, templates: dict[str, str]):
        self.words = WordHashes(normal)
        self.names = list(templates)
        self.seqs = [self.words.of(t.encode().lower().split()) for t in templates.values()]
        must = {self.words[w] for w in NAMES}
        before = {self.words[w] for w in BEFORE_VERSION}
        self.others = [{self.words[w] for w in OTHERS} - set(q.tolist()) for q in self.seqs]
        self.must = []
        for text, q in zip(templates.values(), self.seqs, strict=True):
            words = [normal(w) for w in text.encode().lower().split()]
            self.must.append({i for i, h in enumerate(q.tolist()) if h in must or (i and int(q[i - 1]) in before and words[i][:1].isdigit())})
        entries = [(int(h[p]), t, int(p)) for t, s in enumerate(self.seqs) for h in [runs(s, K)] for p in winnow(h)]
        entries.sort()
        self.keys = np.array([e[0] for e in entries], np.uint64)
        self.where = [(t, p) for _, t, p in entries]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.keys >> np.uint64(48)).astype(int)] = True

    def another(self, seq: np.ndarray, t: int, path: list[tuple[int, int]]) -> bool:
        """Whether what differs between the matched words, or right beside them, tells of another licence."""
        (low, first), (high, last) = path[0], path[-1]
        lacking = self.must[t] - {i for i, _ in path}
        beside = {low - 1} if first else set()
        beside |= {high + 1} if last + 1 < len(seq) else set()
        if any(low <= i <= high or i in beside for i in lacking):
            return True
        own = {j for _, j in path}
        return any(j not in own and int(seq[j]) in self.others[t] for j in range(first, last + 1))

    def passages(self, seq: np.ndarray, t: int, seeds: list[tuple[int, int]]):
        """Matched places of each run of neighbouring hits (template place, shift)."""
        at, template = 0, self.seqs[t]
        while at < len(seeds):
            end, far = at + 1, {seeds[at][1]}
            while end < len(seeds) and seeds[end][0] - seeds[end - 1][0] <= GAP:
                far.add(seeds[end][1])
                end += 1
            (low, first), (high, last) = seeds[at], seeds[end - 1]
            high += K
            while low > 0 and 0 < low + first <= len(seq) and template[low - 1] == seq[low + first - 1]:
                low -= 1
            while high < len(template) and high + last < len(seq) and template[high] == seq[high + last]:
                high += 1
            n, path = align(seq, template[low:high], min(far) + low, max(far) + low)
            if n >= K + WINDOW - 1:
                yield [(i + low, j) for i, j in path]
            at = end

    def matches(self, text: str | None, partial: bool = False) -> list[tuple[str, int, int, float, int]]:
        """(template, start, end, coverage, equal words) of a text, by start."""
        if not text:
            return []
        seq = self.words.of(text.encode().lower().split())
        hashes = runs(seq, K)
        near = np.flatnonzero(self.sieve[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(near):
            return []
        proposed: dict[int, dict[int, list[int]]] = {}
        left = np.searchsorted(self.keys, hashes[near], "left")
        right = np.searchsorted(self.keys, hashes[near], "right")
        for at, a, b in zip(near.tolist(), left.tolist(), right.tolist(), strict=True):
            for t, p in self.where[a:b]:
                proposed.setdefault(t, {}).setdefault(at - p, []).append(p)
        if not proposed:
            return []
        found = []
        for t, shifts in proposed.items():
            template = self.seqs[t]
            groups: list[list[int]] = []
            for shift in sorted(shifts):
                if groups and shift - groups[-1][0] <= BAND // 2:
                    groups[-1].append(shift)  # the band of the diagonal before covers this one
                else:
                    groups.append([shift])
            for group in groups:
                n, path = align(seq, template, group[0], group[-1])
                if n >= MIN_COVERAGE * len(template):
                    paths = [path]
                elif partial:
                    paths = self.passages(seq, t, sorted((p, shift) for shift in group for p in shifts[shift]))
                else:
                    continue
                found += [(-len(p) / len(template), p[0][1], p[-1][1], len(p), t) for p in paths if not self.another(seq, t, p)]
        if not found:
            return []
        spans = [m.span() for m in re.finditer(WORD, text)]
        taken: dict[int, list[tuple[int, int]]] = {}
        out = []
        for cover, a, b, n, t in sorted(found):
            own = taken.setdefault(t, [])  # disjoint, in order
            at = bisect_right(own, (b, len(seq)))
            if not at or own[at - 1][1] < a:
                own.insert(at, (a, b))
                out.append((self.names[t], spans[a][0], spans[b][1], -cover, n))
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


SCHEMA = "doc_id bigint, license string, start int, end int, coverage double, n_words int, complete boolean"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, partial: bool = False) -> DataFrame:
    """A row for each match, partial ones only if asked for; no shuffle."""
    chosen = TEMPLATES if templates is None else templates

    def make():
        index = Index(chosen)

        def step(columns: list[list]) -> list[list]:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, text in zip(*columns, strict=True):
                for row in index.matches(text, partial):
                    for column, value in zip(out, (doc_id, *row, row[3] >= MIN_COVERAGE), strict=True):
                        column.append(value)
            return out

        return step

    return arrow_map(
        docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], SCHEMA, make
    )
