"""License scan by patience alignment of templates and texts.

For every occurrence of a template's rarest words, the stretch of text around it that the template could
cover is aligned with the template: words that occur once in both are anchors, the longest increasing
subsequence of them is kept, and the gaps between anchors are aligned in the same way. Where a gap has
no such words, equal words at its two ends are matched. Coverage is the share of the template's words
that are matched; a license is found from ``min_coverage`` on. Stretches with too few of a template's rarer words are not
aligned: they cannot reach the coverage. Of overlapping finds the one with most matched words, less missing and extra
ones, stays: a text with two of three clauses is told from one with three, and a header from the notice in it.

Defined results: a null or wordless text has no licenses; a template without words is never found;
repeated rows are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import dataclasses
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.arrays import NORMAL_WORD, lower_ascii, slices, small_batches

MIN_COVERAGE = 0.8
# Words of a template that locate candidates; one of them must occur for the rest to reach coverage.
MAX_TEMPLATE_CHARS = 4_000_000

# Notices by which texts name their license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


# Whole license texts and the standard headers of longer ones; names and years are left out.
TEXTS = {
    "MIT": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE.
        """,
    "ISC": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
        OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
        """,
    "BSD-2-Clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.

        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.
        """,
    "BSD-3-Clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.

        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.

        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.
        """,
    "Apache-2.0": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at

        http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.
        """,
    "GPL-3.0": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.

        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details.

        You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.
        """,
}


def word_list(text: str | None) -> list[str]:
    return NORMAL_WORD.findall(lower_ascii(text)) if text else []


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for position, value in enumerate(values):
        pile = bisect.bisect_left(tops, value)
        if pile:
            before[position] = piles[pile - 1]
        if pile == len(tops):
            tops.append(value)
            piles.append(position)
        else:
            tops[pile] = value
            piles[pile] = position
    chain, position = [], piles[-1] if piles else -1
    while position >= 0:
        chain.append(position)
        position = before[position]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched positions ``(in text, in template)``, increasing in both."""
    matches: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        t0, t1, m0, m1 = gaps.pop()
        while t0 < t1 and m0 < m1 and text[t0] == template[m0]:
            matches.append((t0, m0))
            t0, m0 = t0 + 1, m0 + 1
        while t0 < t1 and m0 < m1 and text[t1 - 1] == template[m1 - 1]:
            t1, m1 = t1 - 1, m1 - 1
            matches.append((t1, m1))
        if t0 == t1 or m0 == m1:
            continue
        once = Counter(template[m0:m1])
        there = Counter(text[t0:t1])
        place = {word: at for at, word in enumerate(text[t0:t1], t0)}
        anchors = [
            (place[word], at)
            for at, word in enumerate(template[m0:m1], m0)
            if once[word] == 1 and there.get(word) == 1
        ]
        if not anchors:
            continue
        anchors = [anchors[i] for i in increasing([a[0] for a in anchors])]
        matches.extend(anchors)
        for (a, b), (c, d) in zip([(t0 - 1, m0 - 1), *anchors], [*anchors, (t1, m1)], strict=True):
            if c - a > 1 and d - b > 1:
                gaps.append((a + 1, c, b + 1, d))
    return sorted(matches)


@dataclasses.dataclass
class Template:
    name: str
    words: list[str]
    keys: dict[str, list[int]]
    rare: frozenset[str]
    least_rare: int


def templates_of(rows: list[tuple[str, str]], min_coverage: float) -> list[Template]:
    """Templates with the words that locate them.

    A text that covers the template misses at most ``n - ceil(min_coverage * n)`` of its ``n`` words, so it
    has one of any ``missing + 1`` of them: ``keys`` with their places, the words rarest over all templates. For the same reason it has
    ``least_rare`` of a larger set of ``rare`` words, of which common words in a text do not make up as many.
    """
    split = [(name, word_list(text)) for name, text in rows]
    everywhere = Counter(word for _, words in split for word in words)
    found = []
    for name, words in split:
        if not words:
            continue
        missing = len(words) - _needed(len(words), min_coverage)
        counts = Counter(words)
        order = sorted(counts, key=lambda word: (everywhere[word], -len(word), word))
        keys, _ = _rarest(order, counts, missing + 1)
        rare, places = _rarest(order, counts, missing + (len(words) - missing + 1) // 2)
        at_keys = {key: [at for at, word in enumerate(words) if word == key] for key in keys}
        found.append(Template(name, words, at_keys, rare, places - missing))
    return found


def _rarest(order: list[str], counts: Counter, places: int) -> tuple[frozenset[str], int]:
    """The first words of an order that have so many places in a template, and their places."""
    taken, held = set(), 0
    for word in order:
        if held >= places:
            break
        taken.add(word)
        held += counts[word]
    return frozenset(taken), held


def _needed(words: int, min_coverage: float) -> int:
    return max(1, int(-(-words * min_coverage // 1)))


def find_licenses(
    words: list[str], templates: list[Template], min_coverage: float
) -> list[tuple[str, int, int, float]]:
    """Spans ``(license, first word, word after the last, coverage)``. Of overlapping spans the best stays: by
    matched words less the template's missing and the text's extra ones, then the first, the shorter, the name."""
    keys = set().union(*(t.keys for t in templates)) if templates else set()
    if keys.isdisjoint(words):
        return []
    wanted = keys.union(*(t.rare for t in templates))
    spots: dict[str, list[int]] = {}
    for at, word in enumerate(words):
        if word in wanted:
            spots.setdefault(word, []).append(at)
    spans = set()
    for template in templates:
        size = len(template.words)
        reach = size + size // 4
        needed = _needed(size, min_coverage)
        rare = sorted(at for word in template.rare for at in spots.get(word, ()))
        for at in sorted({at for key in template.keys for at in spots.get(key, ())}):
            low = max(0, at - reach)
            # Both sides on their own, and the template laid on the key with little around it: copies side by side
            # must not hide each other's anchors.
            stretches = {(low, at + reach), (at, at + reach), (low, at + 1)}
            for place in template.keys[words[at]]:
                first = at - place
                stretches.add((max(0, first - size // 16), first + size + size // 16))
            for start, stop in stretches:
                if bisect.bisect_left(rare, stop) - bisect.bisect_left(rare, start) < template.least_rare:
                    continue
                matched = align(words[start:stop], template.words)
                if len(matched) >= needed:
                    first, last = start + matched[0][0], start + matched[-1][0] + 1
                    unlike = size + last - first - 2 * len(matched)
                    spans.add((unlike - len(matched), first, last, template.name, len(matched) / size))
    taken: list[tuple[int, int]] = []
    found = []
    for _, first, last, name, coverage in sorted(spans):
        # Spans that are taken do not overlap, so only the neighbours in order need be looked at.
        at = bisect.bisect_left(taken, (first, last))
        if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or taken[at][0] >= last):
            taken.insert(at, (first, last))
            found.append((name, first, last, coverage))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


SPANS = "array<struct<license: string, first_word: int, end_word: int, coverage: double>>"


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | Iterable[tuple[str, str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """``(id, n_words, spans)`` per row of ``docs``. A license may have several templates, given as pairs; notices,
    headers and whole texts are built in. Templates travel with the task, at most ``MAX_TEMPLATE_CHARS``
    characters of them; scan larger sets in parts."""
    if templates is None:
        rows = [*TEMPLATES.items(), *TEXTS.items()]
    else:
        rows = list(templates.items() if isinstance(templates, dict) else templates)
    if sum(len(text) for _, text in rows) > MAX_TEMPLATE_CHARS:
        raise ValueError("scan large template sets in parts")
    small_batches(docs.sparkSession)
    known = templates_of(rows, min_coverage)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("license", "first_word", "end_word", "coverage")
        for batch in slices(batches):
            counts, spans = [], []
            for text in batch.column("text").to_pylist():
                words = word_list(text)
                counts.append(len(words))
                hits = find_licenses(words, known, min_coverage)
                spans.append([dict(zip(names, hit, strict=True)) for hit in hits])
            kind = pa.list_(
                pa.struct(
                    [("license", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())]
                    + [("coverage", pa.float64())]
                )
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(spans, kind)],
                ["id", "n_words", "spans"],
            )

    rows_in = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(scan, f"id bigint, n_words bigint, spans {SPANS}")
