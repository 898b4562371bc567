"""Licence scans with a generalised suffix automaton of licence tokens.

A text's words are streamed through the automaton of all template texts, which gives
the longest template substring that ends at each word. Long maximal matches are chained,
template by template, into covered spans. Beside them stand the base phrases, exact
places of a few fixed word sequences.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewarden.llm.common import columns_of, id_text, id_type

# Base phrases and their labels
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# The wording of licences, and of the notices that they ask for
WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or "
    "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", WARRANTY),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", GNU.format("General Public License", "3")),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("lgpl", GNU.format("Lesser General Public License", "3")),
    ("agpl", GNU.format("Affero General Public License", "3")),
    ("agpl", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("bsd", CONDITIONS),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", DISCLAIMER),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "Licensed under CC0 1.0 Universal."),
]
#: Attribution licences by their parts: the notice in words and in short.
PARTS = {"nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
for _code in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
    _label, _name = "-".join(("cc-by", *_code)), "-".join(("Attribution", *(PARTS[c] for c in _code)))
    for _version in ("4.0 International", "3.0 Unported"):
        TEMPLATES.append((_label, f"This work is licensed under a Creative Commons {_name} {_version} License"))
    TEMPLATES.append((_label, f"Licensed under CC {'-'.join(('BY', *_code)).upper()} 4.0."))

#: Upper-case letters to lower case, every byte that belongs to no word to a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split(b" ") if text else []


class Automaton:
    """Suffix automaton of several token sequences. Each state knows where its substrings
    end in the templates; templates are small, so these lists are too."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for template, tokens in enumerate(sequences):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].append((template, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """``q`` when it is one longer than ``p``, else a copy of it that is."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest substring that ends at each token."""
        state = size = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                size += 1
            yield state, size


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], base: list[tuple[str, str]], min_match: int, max_gap: int, coverage: float):
        sequences = [[w for w in words_of(t) if w] for _, t in templates]
        phrases = [(p.encode().split(), label) for p, label in base]
        self.ids: dict[bytes, int] = {}
        for w in [w for s in sequences for w in s] + [w for p, _ in phrases for w in p]:
            self.ids.setdefault(w, len(self.ids))
        self.sizes = [len(s) for s in sequences]
        self.labels = [label for label, _ in templates]
        self.automaton = Automaton([[self.ids[w] for w in s] for s in sequences])
        self.phrases = [([self.ids[w] for w in p], label) for p, label in phrases]
        self.min_match, self.max_gap, self.coverage = min_match, max_gap, coverage

    def _runs(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """(start, ids) of the runs of known words; others end every match."""
        got = list(map(self.ids.get, words))
        runs: list[tuple[int, list[int]]] = []
        end = -1
        for i, t in [(i, t) for i, t in enumerate(got) if t is not None]:
            if i != end:
                runs.append((i, []))
            runs[-1][1].append(t)
            end = i + 1
        return [r for r in runs if len(r[1]) > 1]

    def _matches(self, runs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int]]:
        """(template, place there, place in the text, length) of the long maximal matches."""
        out = []
        for start, ids in runs:
            if len(ids) < self.min_match:
                continue
            stats = list(self.automaton.statistics(ids))
            for i, (state, size) in enumerate(stats):
                if size >= self.min_match and (i + 1 == len(stats) or stats[i + 1][1] <= size):
                    out += [(t, e - size + 1, start + i - size + 1, size) for t, e in self.automaton.ends[state]]
        return out

    def _chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, share of the template covered).

        Matches of a template are taken in text order; one that lies further on in the
        template and not too far on in the text lengthens the chain, others start one. A
        chain is closed when the text has left it behind, so a match looks at the few that end
        near it, however often a phrase is repeated.
        """
        spans = []
        for t in sorted({m[0] for m in matches}):
            chains: list[list[int]] = []  # template end, text start, text end, covered; those that may go on
            for _, at, place, size in sorted((m for m in matches if m[0] == t), key=lambda m: (m[2], m[1])):
                ends = at + size, place + size
                over = [c for c in chains if place - c[2] > self.max_gap]
                if over:  # matches come by place: nothing that follows is near enough
                    spans += [(t, c[1], c[2], c[3]) for c in over]
                    chains = [c for c in chains if place - c[2] <= self.max_gap]
                fits = [c for c in chains if ends[0] > c[0] and ends[1] > c[2]]
                if fits:
                    c = max(fits, key=lambda c: c[3])
                    c[3] += min(size, ends[0] - c[0], ends[1] - c[2])
                    c[0], c[2] = ends
                else:
                    chains.append([ends[0], place, ends[1], size])
            spans += [(t, c[1], c[2], c[3]) for c in chains]
        return [(t, a, b, min(1.0, n / self.sizes[t])) for t, a, b, n in spans]

    def _best(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of overlapping spans the one that most words of its template cover, in text order.

        Spans come by covered words, then by covered share; one goes where a better one has a
        word of it.
        """
        taken: list[tuple[int, int, int, float]] = []
        starts: list[int] = []
        for s in sorted(spans, key=lambda s: (-round(s[3] * self.sizes[s[0]]), -s[3], s[2] - s[1], s[1], s[0])):
            at = bisect_right(starts, s[1])
            if (at and taken[at - 1][2] > s[1]) or (at < len(taken) and taken[at][1] < s[2]):
                continue
            taken.insert(at, s)
            starts.insert(at, s[1])
        return taken

    def scan(self, text: str) -> tuple:
        """Words, base places, first and last of them, base labels, all labels, score, spans."""
        words = [w for w in words_of(text) if w]
        runs = self._runs(words)
        places, base = [], set()
        for start, ids in runs:
            for phrase, label in self.phrases:
                for i in range(len(ids) - len(phrase) + 1):
                    if ids[i : i + len(phrase)] == phrase:
                        places.append(start + i)
                        base.add(label)
        spans = self._chain(self._matches(runs))
        found = self._best([s for s in spans if s[3] >= self.coverage])
        labels = base | {self.labels[s[0]] for s in found}
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            max((s[3] for s in spans), default=0.0),
            [{"label": self.labels[t], "template": t, "first_word": a, "words": b - a, "covered": c} for t, a, b, c in found],
        )


FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("covered", pa.float64())]))),
]


def _scan(templates: list, base: list, min_match: int, max_gap: int, coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base, min_match, max_gap, coverage)
        for batch in batches:
            (texts,) = columns_of(batch, "text")
            rows = list(zip(*map(scanner.scan, texts), strict=True)) or [[] for _ in FIELDS]
            columns = [pa.array(c, t) for c, (_, t) in zip(rows, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(n for n, _ in FIELDS)])

    return run


def scan_licences(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
    base: list[tuple[str, str]] = BASE, min_match: int = 4, max_gap: int = 20, coverage: float = 0.8,
) -> DataFrame:
    """Base places, labels and covered template spans of every whole text.

    ``labels`` has the base labels and those of templates of which a chain of matches, each
    of ``min_match`` words at least and no more than ``max_gap`` words apart, covers the
    share ``coverage``; of overlapping chains the one with the most covered words labels
    the span. ``score`` is the largest share of a template that a chain covers.
    Null and empty texts have no words, no labels (empty strings) and score 0; without a
    base place first and last word are null; repeated rows get a row each.
    """
    spans = "spans array<struct<label:string,template:bigint,first_word:bigint,words:bigint,covered:double>>"
    schema = f"doc_id {id_type(docs, id_col)}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, {spans}"
    return id_text(docs, id_col, text_col).mapInArrow(_scan(templates, base, min_match, max_gap, coverage), schema)
