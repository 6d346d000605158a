"""License scans: a generalised suffix automaton over licence tokens.

The templates' words are one automaton. A document's words stream through it and give, at each word,
the longest run that ends there and stands in some template (matching statistics). Long runs of one
template that keep their order and lie close together chain into a span. What several licences share
says little: a template's word weighs less, the more licences have the runs around it, and a span is a
label when it covers enough of its template's weight and holds a run that no other licence has. Phrases
are found by the same walk: a phrase ends where the state, or one of its suffix links, is the phrase's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BYTES

#: The phrases that count as a label by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
GNU = "{who} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
CREATIVE = "This work is licensed under a Creative Commons Attribution{kind} 4.0 International License."

#: Passages of public licences.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        AS_IS.format(who="AUTHORS OR COPYRIGHT HOLDERS"),
        "released under the MIT license",
        "licensed under the MIT license",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": BSD,
    "bsd-3": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        AS_IS.format(who="AUTHORS"),
    ],
    "gpl-2": [GNU.format(who="This program", kind="General", version="2"), GNU_WARRANTY.format(kind="General")],
    "gpl-3": [GNU.format(who="This program", kind="General", version="3"), GNU_WARRANTY.format(kind="General")],
    "lgpl-3": [GNU.format(who="This library", kind="Lesser General", version="3"), GNU_WARRANTY.format(kind="Lesser General")],
    "agpl-3": [GNU.format(who="This program", kind="Affero General", version="3"), GNU_WARRANTY.format(kind="Affero General")],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by": [CREATIVE.format(kind=""), "https://creativecommons.org/licenses/by/4.0/"],
    "cc-by-sa": [CREATIVE.format(kind="-ShareAlike"), "https://creativecommons.org/licenses/by-sa/4.0/"],
    "cc-by-nc": [CREATIVE.format(kind="-NonCommercial"), "https://creativecommons.org/licenses/by-nc/4.0/"],
    "cc-by-nd": [CREATIVE.format(kind="-NoDerivatives"), "https://creativecommons.org/licenses/by-nd/4.0/"],
    "cc-by-nc-sa": [CREATIVE.format(kind="-NonCommercial-ShareAlike"), "https://creativecommons.org/licenses/by-nc-sa/4.0/"],
    "cc-by-nc-nd": [CREATIVE.format(kind="-NonCommercial-NoDerivatives"), "https://creativecommons.org/licenses/by-nc-nd/4.0/"],
    "cc0-1": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "https://creativecommons.org/publicdomain/zero/1.0/"],
}


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_BYTES).split()


class Automaton:
    """Generalised suffix automaton of word sequences; state 0 is the root."""

    def __init__(self, passages: list[tuple[str, list[bytes]]], phrases: dict[str, str]) -> None:
        """passages: (label, words); phrases are passages of their own, after them."""
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.passages = [(label, tuple(words)) for label, words in passages if words]
        ends: list[tuple[int, int, int]] = []
        for k, (_, words) in enumerate(self.passages):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                ends.append((last, k, i))
        #: (passage, index of the last word) for the runs that end in a state; those of its subtree count too.
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.step]
        for state, k, i in ends:
            while state > 0:
                self.places[state].append((k, i))
                state = self.link[state]
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        own: dict[int, tuple[int, str]] = {}
        for words, label in self.phrases:
            state = 0
            for w in words:
                state = self.step[state][w]
            own[state] = (len(words), label)
        self.found: list[list[tuple[int, str]]] = []
        for s in range(len(self.step)):
            here, state = [], s
            while state > 0:
                if state in own:
                    here.append(own[state])
                state = self.link[state]
            self.found.append(here)
        self.words = frozenset(w for _, words in self.passages for w in words)
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for label, words in self.passages:
            for g in _runs(words):
                owners.setdefault(g, set()).add(label)
        #: For each passage, the weight of each word.
        self.weight: list[list[float]] = []
        for _, words in self.passages:
            weight = [0.0] * len(words)
            for i, g in enumerate(_runs(words)):
                for k in range(i, i + len(g)):
                    weight[k] = max(weight[k], 1 / len(owners[g]))
            self.weight.append(weight)

    def _new(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.step[last]:
            to = self.step[last][w]
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, w, to)
        cur = self._new(self.length[last] + 1, {}, -1)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            to = self.step[p][w]
            self.link[cur] = to if self.length[to] == self.length[p] + 1 else self._clone(p, w, to)
        return cur

    def _clone(self, p: int, w: bytes, to: int) -> int:
        twin = self._new(self.length[p] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = twin
        while p >= 0 and self.step[p].get(w) == to:
            self.step[p][w] = twin
            p = self.link[p]
        return twin

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest run of template words that ends at each position."""
        step, link, lengths, known = self.step, self.link, self.length, self.words
        state = n = 0
        for i, w in enumerate(words):
            if w not in known:
                state = n = 0
                continue
            while state and w not in step[state]:
                state = link[state]
                n = lengths[state]
            if w in step[state]:
                state = step[state][w]
                n += 1
                yield i, state, n
            else:
                n = 0

    def scan(self, words: list[bytes], least: int, gap: int, share: float) -> tuple[list[tuple[int, str, int]], list[tuple[str, int, int, float]], float]:
        """(phrase places, spans, score): (start, label, words) each, (label, start, end, share covered) each, the best share."""
        base: list[tuple[int, str, int]] = []
        runs: dict[int, list[tuple[int, int, int, bool]]] = {}
        prev: tuple[int, int, int] | None = None
        for i, state, n in self.walk(words):
            base += [(i - size + 1, label, size) for size, label in self.found[state] if size <= n]
            if prev and (prev[0] != i - 1 or n <= prev[2]) and prev[2] >= least:
                self._place(runs, *prev)
            prev = (i, state, n)
        if prev and prev[2] >= least:
            self._place(runs, *prev)
        spans, best = [], 1.0 if base else 0.0
        for k, found in runs.items():
            label = self.passages[k][0]
            total = sum(self.weight[k])
            for start, end, parts, alone in _chains(sorted(found), gap):
                own = {i for at, n in parts for i in range(at, at + n)}
                part = min(1.0, sum(self.weight[k][i] for i in own) / total)
                if alone:
                    best = max(best, part)
                    if part >= share:
                        spans.append((label, start, end, part))
        return sorted(base), sorted(spans, key=lambda s: (s[1], s[2], s[0])), best

    def _place(self, runs: dict[int, list[tuple[int, int, int, bool]]], i: int, state: int, n: int) -> None:
        """A run that grows no further, as (start in the document, start in the passage, words, if one licence alone has it)
        for each passage that has it.
        """
        have = [(k, last) for k, last in self.places[state] if last + 1 >= n]
        alone = len({self.passages[k][0] for k, _ in have}) == 1
        for k, last in have:
            runs.setdefault(k, []).append((i - n + 1, last - n + 1, n, alone))


#: Words of the runs that tell licences apart.
RUN = 5


def _runs(words: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    size = min(RUN, len(words))
    return [words[i : i + size] for i in range(len(words) - size + 1)]


def _chains(runs: list[tuple[int, int, int, bool]], gap: int) -> list[tuple[int, int, list[tuple[int, int]], bool]]:
    """Runs of one passage joined while both orders go on and the gap is small: (start, end, parts of the passage, if a run
    is the licence's alone).
    """
    out: list[list] = []
    for start, at, n, alone in runs:
        if out:
            c = out[-1]
            over = max(0, c[1] - start, c[3] - at)
            if start - c[1] <= gap and at >= c[4] and over < n:
                c[1], c[3], c[4], c[5] = start + n, at + n, at, c[5] or alone
                c[2].append((at, n))
                continue
        out.append([start, start + n, [(at, n)], at + n, at, alone])
    return [(c[0], c[1], c[2], c[5]) for c in out]


def automaton(templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Automaton:
    passages = [(label, tokens(t)) for label, texts in templates.items() for t in texts]
    return Automaton([*passages, *((label, tokens(p)) for p, label in phrases.items())], phrases)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>"
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
_TYPES = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = 5, gap: int = 12, share: float = 0.4) -> DataFrame:
    """Per row of docs: places of the phrases, covered spans of the templates, labels and the best coverage.

    A run has least words or more, runs at most gap words apart chain, and a span is a label when it
    covers share of its template's weight and holds a run of its licence alone. score is the best share
    of such a span, 1 where a phrase stands. Null and wordless texts have no place, empty labels and
    score 0. No shuffle: each text is read whole, where it is, however long. Repeated rows and null ids
    have results of their own; extra columns are not read; an empty table gives no rows.
    """
    found = automaton(templates, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = tokens(t)
                base, spans, score = found.scan(words, least, gap, share)
                labels = {x[1] for x in base}
                rows.append((i, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), score, [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in spans]))
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows, strict=True)) or [[]] * len(_TYPES), _TYPES, strict=True)], schema=pa.schema(_TYPES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
