"""Licence notices in texts: Dice coefficient of word bigrams against templates.

The units of a text are the whole text, its paragraphs, lines and sentences. A unit and a template
are compared as multisets of bigrams of normalised words: 2 |both| / (|unit| + |template|). A unit
that reaches the threshold has at least ``threshold / (2 - threshold)`` and at most the inverse of
that times the template's bigrams, and holds enough bigrams known to any template; only templates
that pass both bounds are compared.

Notices that no unit holds by itself, of several paragraphs or amid other prose, are found as
windows: runs of words anywhere in the text that begin and end with a bigram of the template. A
run's gain, 2 |both| - threshold |run|, must reach threshold |template|; a start is left where its
gain falls below zero, since a later one does no worse.

Licences of one family differ in a word or a number that hardly moves the coefficient. So the marks
of a template, its version numbers and the words of ``KINDS``, must be in the unit or window, which
may hold no number of one or two digits and no such word beyond the template's own.
"""

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.workers import arrow_map

THRESHOLD = 0.8

#: Notices as their licences word them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful,
        but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
        copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. 3. Neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.""",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies.""",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
    IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
    A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
    DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
    CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
    OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
    DAMAGE."""
_BSD_3 = TEMPLATES["BSD-3-Clause"][1]
_BSD_2 = _BSD_3[:_BSD_3.index("3. Neither")]
_GPL_3 = TEMPLATES["GPL-3.0"][2]
_MPL = "Mozilla Public License"
TEMPLATES["BSD-3-Clause"] += [f"{_BSD_3} {_BSD_DISCLAIMER}"]
TEMPLATES["MPL-2.0"] += [f"Licensed under the {_MPL}, version 2.0.", f"Licensed under the {_MPL} 2.0."]
TEMPLATES["ISC"] += ["Licensed under the ISC License.", "Released under the ISC License."]
TEMPLATES |= {
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD_2, f"{_BSD_2} {_BSD_DISCLAIMER}"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.", _GPL_3.replace("version 3", "version 2"),
    ],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
}
for _name, _kind, _number in (("LGPL-3.0", "Lesser", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("AGPL-3.0", "Affero", "3")):
    TEMPLATES[_name] = [
        f"Licensed under the GNU {_kind} General Public License, version {_number}.",
        " ".join(_GPL_3.split()).replace("GNU General", f"GNU {_kind} General").replace("version 3", f"version {_number}"),
    ]
for _kind, _long in (
    ("NC-SA", "NonCommercial-ShareAlike"), ("ND", "NoDerivatives"), ("NC-ND", "NonCommercial-NoDerivatives"),
):
    TEMPLATES[f"CC-BY-{_kind}-4.0"] = [
        f"Licensed under CC BY-{_kind} 4.0.",
        f"This work is licensed under a Creative Commons Attribution-{_long} 4.0 International License.",
    ]
TEMPLATES["MPL-1.1"] = [
    f"Licensed under the {_MPL}, version 1.1.", f"Licensed under the {_MPL} 1.1.",
    """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may
    not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.mozilla.org/MPL/
    Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND,
    either express or implied. See the License for the specific language governing rights and limitations
    under the License.""",
]

#: Words that tell licences of a family apart, in the form of ``words``.
KINDS = {
    "lesser", "affero", "nc", "noncommercial", "commercial", "sa", "sharealike", "nd", "noderivatives", "noderivs",
    "derivatives", "derivs",
}
#: A window inside a longer match of another licence has to be better than that by so much.
PART = 0.1
#: Words after a window in which a number of its template may still stand.
AFTER = 2
_LISTED = re.compile(r"(?<!version )(?<!v\. )\b\d+\.\s+(?=[A-Z][a-z])")

_WORD = re.compile(r"\w+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")

FOUND = "doc_id long, license string, n_units long, dice double, start long, end long"


def words(text: str) -> list[str]:
    """Lower-case words; both spellings of a licence are one."""
    return [w.replace("licence", "license") for w in _WORD.findall(text.lower())]


def bigrams(seq: list[str]) -> Counter:
    """Pairs of neighbouring words; a single word is a pair with nothing."""
    return Counter(zip(seq, seq[1:], strict=False)) if len(seq) != 1 else Counter({(seq[0], ""): 1})


def marks(seq: list[str]) -> Counter:
    """Numbers of one or two digits, but for a zero, and words of ``KINDS``."""
    return Counter(w for w in seq if w in KINDS or w != "0" and len(w) <= 2 and w.isdecimal())


def _pieces(text: str, start: int, end: int, mark: re.Pattern):
    at = start
    for m in mark.finditer(text, start, end):
        yield at, m.start()
        at = m.end()
    yield at, end


def _spots(text: str) -> list[tuple[int, int, str]]:
    lower = text.lower()
    if len(lower) == len(text):
        return [(m.start(), m.end(), m[0].replace("licence", "license")) for m in _WORD.finditer(lower)]
    return [(m.start(), m.end(), w) for m in _WORD.finditer(text) for w in words(m[0])]


class Templates:
    def __init__(self, templates: dict[str, list[str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        each = []
        for name, texts in templates.items():
            for text in texts:
                found = bigrams(words(text))
                # numbers of a list's items may be left out, those of versions may not
                needed = marks(words(_LISTED.sub("", text)))
                each.append((sum(found.values()), name, found, (needed, marks(words(text)))))
        each.sort(key=lambda t: t[:2])
        self.templates, self.marks = [t[:3] for t in each], [t[3] for t in each]
        self.known = {b for t in self.templates for b in t[2]}
        ratio = threshold / (2 - threshold)
        self.owners: dict[tuple, list[int]] = {}
        for i, template in enumerate(self.templates):
            for b in template[2]:
                self.owners.setdefault(b, []).append(i)
        self.one_word = any(second == "" for _, second in self.known)
        sizes = [t[0] for t in self.templates] or [0]
        self.ratio, self.least, self.most = ratio, min(sizes) * ratio - 1e-9, max(sizes) / ratio + 1e-9

    def told_apart(self, template: int, spots: list[tuple], first: int, last: int, more: int = 0) -> bool:
        """Whether the words from ``first`` up to ``last`` have the marks of a template and no other ones."""
        needed, allowed = self.marks[template]
        own = marks([w for _, _, w in spots[first:last]])
        missing = needed - own
        if missing and more:  # a number may follow the window, unless a word of another kind does too
            after = [w for _, _, w in spots[last:last + more]]
            missing = missing if KINDS.intersection(after) else missing - marks(after)
        return not own - allowed and not missing

    def units(self, text: str):
        """(start, end) of the units, each span once."""
        seen = set()
        outer = [(0, len(text))]
        for mark in (None, _PARAGRAPH, re.compile("\n"), _SENTENCE_END):
            outer = [p for a, b in outer for p in (_pieces(text, a, b, mark) if mark else [(a, b)])]
            for a, b in outer:
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    yield a, b

    def matches(self, text: str):
        """(name, dice, start, end) of each unit's best template at the threshold or above."""
        # no unit can match if the text holds no bigram of any template
        if not self.templates:
            return
        spots = _spots(text)
        hits = [i for i in range(len(spots) - 1) if (spots[i][2], spots[i + 1][2]) in self.known]
        if not hits and not self.one_word:
            return
        starts, at = [s for s, _, _ in spots], 0
        for a, b in self.units(text):
            first, last = bisect_left(starts, a), bisect_left(starts, b)
            size = max(1, last - first - 1) if last > first else 0
            if not self.least <= size <= self.most or last - first > 1 and (
                2 * (bisect_left(hits, last - 1) - bisect_left(hits, first)) < self.threshold * (size + self.templates[0][0]) - 1e-9
            ):
                continue
            unit = bigrams([w for _, _, w in spots[first:last]])
            best = None
            for t, (n, name, template) in enumerate(self.templates):
                if self.ratio * n - 1e-9 <= size <= n / self.ratio + 1e-9:
                    dice = 2 * (unit & template).total() / (size + n)
                    if dice >= self.threshold and (best is None or dice > best[0]) and self.told_apart(t, spots, first, last):
                        best = dice, name
            if best:
                yield best[1], best[0], a, b

    def _runs(self, hits: list[int], pairs: list[tuple], n: int, template: Counter):
        """(dice, first, last pair) of runs at the threshold, none over another."""
        highest = gain = 0.0
        for before, at in zip([hits[0], *hits], hits, strict=False):
            gain = max(gain - self.threshold * max(0, at - before - 1), 0) + 2 - self.threshold
            highest = max(highest, gain)
        if highest < self.threshold * n - 1e-9:
            return
        k = 0
        while k < len(hits):
            best, used, common = None, Counter(), 0
            for m in range(k, len(hits)):
                size = hits[m] - hits[k] + 1
                if size > n / self.ratio + 1e-9 or 2 * common < self.threshold * (size - 1):
                    break
                pair = pairs[hits[m]]
                if used[pair] < template[pair]:
                    used[pair] += 1
                    common += 1
                if 2 * common >= self.threshold * (size + n) - 1e-9 and (best is None or 2 * common / (size + n) > best[0]):
                    best = 2 * common / (size + n), m
            if best is None:
                k += 1
                continue
            end, used, common, best = best[1], Counter(), 0, (0, 0)
            for j in range(end, k - 1, -1):  # the best start for this end
                pair = pairs[hits[j]]
                if used[pair] < template[pair]:
                    used[pair] += 1
                    common += 1
                best = max(best, (2 * common / (hits[end] - hits[j] + 1 + n), j))
            yield best[0], hits[best[1]], hits[end]
            k = end + 1

    def found(self, text: str):
        """``matches``, and windows that lie over no match or better window.

        A unit gives way to a better window of its own licence before windows of others are weighed.
        """
        units = list(self.matches(text))
        spots = _spots(text)
        pairs = list(zip((w for _, _, w in spots), (w for _, _, w in spots[1:]), strict=False))
        where: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            for t in self.owners.get(pair, ()):
                where.setdefault(t, []).append(i)
        windows = []
        for t, hits in where.items():
            n, name, template = self.templates[t]
            if len(hits) >= self.ratio * n - 1e-9:
                windows += [
                    (-dice, n, name, spots[a][0], spots[b + 1][1]) for dice, a, b in self._runs(hits, pairs, n, template)
                    if self.told_apart(t, spots, a, b + 2, AFTER)
                ]
        spans = [(dice, name, a, b) for name, dice, a, b in units] + [(-minus, name, a, b) for minus, _, name, a, b in windows]
        windows = [  # a notice that is part of a longer one is not found by itself
            (minus, n, name, a, b) for minus, n, name, a, b in windows
            if not any(other != name and c <= a and b <= d and d - c > b - a and dice > -minus - PART for dice, other, c, d in spans)
        ]
        taken = []
        for name, dice, a, b in units:
            own = [(-minus, c, d) for minus, _, other, c, d in windows if other == name and c < b and a < d and -minus > dice]
            dice, a, b = max(own, key=lambda w: (w[0], -w[1]), default=(dice, a, b))
            taken.append((dice, name, a, b))
            yield name, dice, a, b
        for minus, _, name, a, b in sorted(windows):
            if not any(a < d and c < b and (other == name or dice >= -minus) for dice, other, c, d in taken):
                taken.append((-minus, name, a, b))
                yield name, -minus, a, b


def _scan(templates: dict[str, list[str]], threshold: float):
    def run(batches):
        scanner = Templates(templates, threshold)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found: dict[str, list] = {}
                for name, dice, a, b in scanner.found(text.as_py() or ""):
                    found.setdefault(name, []).append((-dice, a, b))
                for name, spans in sorted(found.items()):
                    dice, a, b = min(spans)
                    rows.append((doc_id, name, len(spans), -dice, a, b))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "license", "n_units", "dice", "start", "end"],
                )

    return run


def scanned(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, further: DataFrame | None = None
) -> DataFrame:
    """One row for each document and licence: how many units and windows match, and the best one.

    A unit counts for the template of the highest coefficient; of equal ones, for the shorter
    template, then the name first in the alphabet. ``start`` and ``end`` are code points of the
    best unit (the first of equal ones). Null and empty texts have no row, nor has an empty
    table; rows that repeat an id are scanned each; columns other than ``doc_id`` and ``text``
    are ignored. Texts under a licence of a known family that has no template of its own have no row
    for it. ``further`` has templates more, such as full texts, by ``license`` and ``text``.
    """
    templates = {name: list(texts) for name, texts in (templates or TEMPLATES).items()}
    for row in further.where("license IS NOT NULL AND text IS NOT NULL").collect() if further is not None else []:
        if words(row["text"]):
            templates.setdefault(row["license"], []).append(row["text"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _scan(templates, threshold), FOUND)
