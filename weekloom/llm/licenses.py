"""License scans with a generalised suffix automaton.

The words of all template texts make one automaton, a few thousand states, which goes to the workers. A file's words
run through it once: the matching statistic at each word is the length of the longest run ending there that some
template has. Long runs are placed in the templates that hold them, chained along each template, and give the span that
each template covers. Only stretches of template words are run through the automaton; all others have statistic 0.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import kept

#: Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices by which public licences are applied or granted, with their labels. Whole licences can be given to scan().
TEMPLATES = (
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit-notice", "Released under the MIT License. See the LICENSE file for details."),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not, see
http://www.gnu.org/licenses/."""),
    ("lgpl-notice", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to
the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""),
    ("agpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("bsd-3-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. This notice may not be removed or altered from any source distribution."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
)

#: Words of a run that is placed in templates, and the share of a template that gives its label.
MIN_RUN, MIN_COVER = 5, 0.4

_KEEP = bytes(c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class Automaton:
    """All runs of words of the templates: states, their longest runs, and where a run of each state ends in templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        texts = [words_of(x.encode()) for _, x in templates]
        self.labels = [x for x, _ in templates]
        self.sizes = [len(x) for x in texts]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for x in texts for w in x))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(texts):
            last = 0
            for place, w in enumerate(words):
                last = self._extend(last, self.ids[w])
                self.ends[last].append((t, place))
        for state in sorted(range(len(self.next)), key=lambda s: -self.length[s]):  # a suffix ends wherever its extension does
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(x)) for x in self.ends]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(dict(following))
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the runs of q that are no longer than one word after p; q keeps the others."""
        copy = self._state(self.length[p] + 1, self.link[q], self.next[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, p: int, w: int) -> int:
        q = self.next[p].get(w)
        if q is not None:  # the run is known from an earlier template
            return q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest known run that ends at each word."""
        state = n = 0
        for w in ids:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            yield n, state

    def runs(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, start in it, start in the file, words) of the maximal runs of at least MIN_RUN words. ids: -1 for words of no template."""
        out = []
        known = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < MIN_RUN:
                continue
            found = list(self.statistics(ids[a:b].tolist()))
            for k, (n, state) in enumerate(found):
                if n >= MIN_RUN and (k + 1 == len(found) or found[k + 1][0] <= n):  # it can't be extended
                    out += [(t, end - n + 1, a + k - n + 1, n) for t, end in self.ends[state]]
        return out


def chains(runs: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """(words, first, last): words of one template covered by runs in order in both, with the first and last word of the file's span.

    Runs within twice the template's length belong to one chain, and each run joins all chains in that reach. Of the
    chains that end with a run, those are kept that no other one beats in both words and a later start.
    """
    reach = 2 * size + 20
    ends: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # start and end in file, end in template, (words, chain's start)
    low = 0
    for at, a, n in sorted({(at, a, n) for _, a, at, n in runs}):
        while low < len(ends) and ends[low][0] <= at - reach:
            low += 1
        last, own = at + n - 1, [(n, at)]
        for _, end, to, front in ends[low:]:
            more = n - max(0, end + 1 - at, to + 1 - a)
            if more > 0:
                own += [(words + more, start) for words, start in front if last - start < reach]
        front = []
        for words, start in sorted(own, key=lambda c: (-c[1], -c[0])):
            if not front or words > front[-1][0]:
                front.append((words, start))
        ends.append((at, last, a + n - 1, front))
    return [(words, start, last) for _, last, _, front in ends for words, start in front]


def apart(found: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """Chains of at least so many words that share no word of the file, those of most words first taken, in the file's order."""
    taken: list[tuple[int, int, int]] = []  # first, last, words
    for words, start, end in sorted((c for c in found if c[0] >= least), key=lambda c: (-c[0], c[2] - c[1], c[1])):
        k = bisect(taken, (start, end, words))
        if (k == 0 or taken[k - 1][1] < start) and (k == len(taken) or end < taken[k][0]):
            taken.insert(k, (start, end, words))
    return [(words, start, end) for start, end, words in taken]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, words: long, share: double>>"


def _scan_batches(templates, phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept(("automaton", repr(templates)), lambda: Automaton(templates))
        ids = dict(automaton.ids)
        wanted = [([ids.setdefault(w, len(ids)) for w in words_of(x.encode())], label) for x, label in phrases]
        own_words = len(automaton.ids)
        get = ids.get
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text or b"")
                seen = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                base, first, last = 0, [], set()
                for phrase, label in wanted:
                    n = len(seen) - len(phrase) + 1
                    if n > 0:
                        at = np.flatnonzero(np.logical_and.reduce([seen[j : j + n] == w for j, w in enumerate(phrase)]))
                        if len(at):
                            base += len(at)
                            first += [int(at[0]), int(at[-1])]
                            last.add(label)
                by = defaultdict(list)
                for r in automaton.runs(np.where(seen < own_words, seen, -1)):
                    by[r[0]].append(r)
                spans, score = [], 0.0
                for t, runs in sorted(by.items()):
                    size = automaton.sizes[t]
                    found = chains(runs, size)
                    score = max(score, min(1.0, max(found)[0] / size))
                    spans += [{"label": automaton.labels[t], "first": a, "last": b, "words": n, "share": n / size} for n, a, b in apart(found, MIN_COVER * size)]
                labels = sorted(last | {s["label"] for s in spans})
                rows.append((doc, len(words), base, min(first, default=None), max(first, default=None), ",".join(sorted(last)), ",".join(labels), score, spans))
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names)

    return run


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Counts, labels, score and covered spans of each row of docs, of which doc_id and text are read.

    n_base counts the places where a phrase's words stand one after another; first_word and last_word are the smallest
    and largest of their starts. labels has the phrases' labels and those of templates covered to MIN_COVER; score is
    the largest covered share of a template. spans has every place where a template is covered to MIN_COVER, of several
    alike the first. A null or empty text has no words, no labels and score 0. Each row is judged by itself, repeated ones
    alike; texts of any length are read whole; an empty table gives no rows; names of other columns don't matter.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan_batches(templates, phrases), SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """scan() with spans as a text, label:first-last of each, in order, comma-joined; see there."""
    told = F.transform("spans", lambda s: F.concat(s["label"], F.lit(":"), s["first"].cast("string"), F.lit("-"), s["last"].cast("string")))
    return scan(docs).withColumn("spans", F.array_join(told, ","))
