"""License scans with a generalised suffix automaton of licence words.

The automaton holds all stretches of all templates. A text's words are streamed through it; after each word the state is the
longest suffix of the text so far that occurs in some template, its length the matching statistic. Phrases are templates, too:
a phrase stands where its words are a suffix of the current match. Longer templates are found by
chaining: maximal matches of at least MIN_MATCH words, at every place where a template has them, that lie in order in text and template
are joined when the gaps are small, by dynamic programming over their ends, and a chain that covers enough of a template, MIN_COVER of its words or MIN_WORDS of them, is a span with that template's
label. Licences borrow from each other: of spans that share most of their words, the one that covers most words stays.

Runs of words that are in no template reset the automaton, so most of a text is passed over by array operations.

Defined results: null and empty text have no words and no labels; nothing is cut off, however long the text; repeated rows
each give a row.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import table, tune

MIN_MATCH = 4
MAX_GAP = 8
MIN_COVER = 0.6
MIN_WORDS = 20

#: Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Texts and notices of common licences; their words are public and fixed.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
        have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
        OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties
        to whom the Software is furnished to do so"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
    ("cc", "This work is licensed under the Creative Commons Attribution"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)

#: A-Z lower-cased, every byte that is no letter, digit or part of a non-ASCII character turned into a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


@dataclass(frozen=True)
class Span:
    """Words first to last (not included) of a text, chained to a template of which they cover a share, so many words."""

    label: str
    first: int
    last: int
    cover: float
    words: int


class LicenseAutomaton:
    """Generalised suffix automaton over numbered words of phrases and templates."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER, min_words: int = MIN_WORDS):
        self.min_match, self.max_gap, self.min_cover, self.min_words = min_match, max_gap, min_cover, min_words
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Where the longest string of a state ends first: (template, end).
        self.where: list[tuple[int, int]] = [(-1, 0)]
        self.texts: list[tuple[str, list[int]]] = []
        for label, text in templates:
            self._add(label, text)
        self.phrases: list[tuple[str, int]] = []
        ends: dict[int, list[int]] = {}
        for text, label in phrases:
            numbers = self._add(label, text)
            state = 0
            for w in numbers:
                state = self.next[state][w]
            ends.setdefault(state, []).append(len(self.phrases))
            self.phrases.append((label, len(numbers)))
        #: By state: the phrases that are suffixes of its strings, found up the links.
        self.suffix: list[tuple[int, ...]] = [()] * len(self.next)
        for state in sorted(range(len(self.next)), key=lambda s: self.length[s]):
            above = self.suffix[self.link[state]] if self.link[state] >= 0 else ()
            self.suffix[state] = (*ends.get(state, ()), *above)
        self.shortest = min([n for _, n in self.phrases] + [min_match])

    def _add(self, label: str, text: str) -> list[int]:
        numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode())]
        self.texts.append((label, numbers))
        last = 0
        for end, w in enumerate(numbers, 1):
            last = self._extend(last, w, (len(self.texts) - 1, end))
        return numbers

    def _extend(self, last: int, w: int, where: tuple[int, int]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state({}, -1, length[last] + 1, where)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.where[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, nxt: dict[int, int], link: int, length: int, where: tuple[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.where.append(where)
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Span]]:
        """Places (start, phrase number) of the phrases, and the spans of covered templates."""
        places, matches = self.matches(words)
        return places, self._chain(matches)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of the phrases, and the maximal matches (first word, length, state) of at least min_match words."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        known = np.flatnonzero(ids)
        if len(known) < self.shortest:
            return [], []
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        begins, ends = known[np.r_[0, cut]], known[np.r_[cut - 1, len(known) - 1]] + 1
        long = ends - begins >= self.shortest
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # first word, length, state
        nxt, link, length, suffix, least = self.next, self.link, self.length, self.suffix, self.min_match
        for begin, end in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            state = size = 0
            for at, w in enumerate(ids[begin:end].tolist(), begin):
                before, longest = state, size
                while state and w not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if size < longest and longest >= least:
                    matches.append((at - longest, longest, before))
                if w in nxt[state]:
                    state, size = nxt[state][w], size + 1
                    for p in suffix[state]:
                        n = self.phrases[p][1]
                        if n <= size:
                            places.append((at + 1 - n, p))
            if size >= least:
                matches.append((end - size, size, state))
        return places, matches

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        """Chains of matches by template, then of those that share most of their words the ones with most covered."""
        anchors: dict[int, list[Anchor]] = {}
        for first, size, state in matches:
            for t, end in self._templates(state, size):
                anchors.setdefault(t, []).append((first, size, end - size))
        spans = []
        for t, own in anchors.items():
            label, numbers = self.texts[t]
            for first, last, covered in chains(own, self.max_gap, min(self.min_words, self.min_cover * len(numbers))):
                spans.append(Span(label, first, last, covered / len(numbers), covered))
        near: dict[int, list[Span]] = {}  # spans that stay, by where they begin, in steps of the longest
        step = max([s.last - s.first for s in spans], default=1)
        for s in sorted(spans, key=lambda s: (-s.words, s.first, s.label, -s.cover)):
            others = (o for k in range(s.first // step - 1, s.last // step + 1) for o in near.get(k, ()))
            if all(2 * (min(s.last, o.last) - max(s.first, o.first)) <= s.last - s.first for o in others):
                near.setdefault(s.first // step, []).append(s)
        return sorted((s for own in near.values() for s in own), key=lambda s: (s.first, s.label))

    @functools.lru_cache(maxsize=1 << 14)  # noqa: B019 - one automaton lives as long as its process
    def _templates(self, state: int, size: int) -> tuple[tuple[int, int], ...]:
        """Every template that holds the match, with each place where it ends there."""
        t, end = self.where[state]
        match = self.texts[t][1][end - size : end]
        return tuple((k, e) for k, (_, numbers) in enumerate(self.texts) for e in range(size, len(numbers) + 1) if numbers[e - size : e] == match)


#: A match at one place of a template: its first word in the text, its size, its first word in the template.
Anchor = tuple[int, int, int]


def best_chains(anchors: Sequence[Anchor], gap: int) -> list[tuple[int, int]]:
    """(covered, first word) of the best chain that ends with each anchor; anchors in order of their ends in the text.

    The next of a chain ends later in the text and in the template, and leaves out at most gap words of either; where it begins before
    the last one's end, what they share counts once. Of chains that cover as much the one that starts last is best.
    """
    out: list[tuple[int, int]] = []
    low = 0
    for k, (first, size, place) in enumerate(anchors):
        while anchors[low][0] + anchors[low][1] < first - gap:
            low += 1
        best = (size, first)
        for b in range(low, k):
            f, n, p = anchors[b]
            shared = max(0, f + n - first, p + n - place)
            if f + n < first + size and p + n < place + size and shared < size and place - p - n <= gap:
                best = max(best, (out[b][0] + size - shared, out[b][1]))
        out.append(best)
    return out


def _meets(taken: list[tuple[int, int]], first: int, last: int) -> bool:
    """Whether words first to last meet one of the sorted, disjoint ranges."""
    at = bisect.bisect_left(taken, (first, first))
    return (at < len(taken) and taken[at][0] < last) or (at > 0 and taken[at - 1][1] > first)


def chains(anchors: Sequence[Anchor], gap: int, least: float) -> list[tuple[int, int, int]]:
    """(first, last, covered) of chains that cover at least so many words and share none, the most covered first.

    Whenever better chains have taken words of some others, chains are sought anew among the anchors that lie apart from all taken.
    """
    todo, found = sorted(anchors, key=lambda a: (a[0] + a[1], a)), []
    while todo:
        best = best_chains(todo, gap)
        ends = sorted((-covered, first, a[0] + a[1]) for a, (covered, first) in zip(todo, best, strict=True) if covered >= least)
        taken: list[tuple[int, int]] = []
        again = False
        for covered, first, last in ends:
            if _meets(taken, first, last):
                again = True
                continue
            bisect.insort(taken, (first, last))
            found.append((first, last, -covered))
        if not again:
            break
        todo = [a for a in todo if not _meets(taken, a[0], a[0] + a[1])]
    return found


_AUTOMATA: dict[tuple, LicenseAutomaton] = {}

_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))


def scan_documents(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every whole text.

    score is the largest share of a template that is covered, 1 where a phrase stands, 0 without any label.
    One narrow pass; the automaton is built once in each Python worker.
    """
    spec = (tuple(phrases), tuple(templates), min_match, max_gap, min_cover, min_words)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if spec not in _AUTOMATA:
            _AUTOMATA[spec] = LicenseAutomaton(*spec)
        automaton = _AUTOMATA[spec]
        for batch in batches:
            rows = []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(raw or b"")
                places, spans = automaton.scan(words)
                base = sorted({automaton.phrases[p][0] for _, p in places})
                labels = sorted({*base, *(s.label for s in spans)})
                starts = [at for at, _ in places]
                score = 1.0 if base else max([s.cover for s in spans], default=0.0)
                found = [{"label": s.label, "first_word": s.first, "last_word": s.last, "cover": s.cover} for s in spans]
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, found))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first_word: bigint, last_word: bigint, cover: double>>",
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every whole text of documents."""
    return scan_documents(table(tune(spark), sf_dir, "documents")).drop("spans")
