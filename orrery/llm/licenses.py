"""License scans by patience alignment of word sequences.

Words that occur once in the text and once in the template are anchors; their longest increasing
subsequence is the spine, and the gaps between its words (and before and after it) are aligned in the same
way, where other words are unique. Coverage is the share of the template's words that are aligned.

A text is aligned with a template only if it has enough of the template's distinct words for the coverage
asked for: a necessary condition, so nothing is missed by it.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import bounded_batches, table, utf8

# Sentences that several licences share, as their publishers word them.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Notices and whole short licences as their publishers word them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", _MIT_GRANT, f"{_MIT_GRANT} {_MIT_WARRANTY}"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD-3-Clause": [f"{_BSD_START} {_BSD_NAME}", f"{_BSD_START} {_BSD_NAME} {_BSD_WARRANTY}"],
    "BSD-2-Clause": [f"{_BSD_START} {_BSD_WARRANTY}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "ISC": [_ISC_GRANT, f"{_ISC_GRANT} {_ISC_WARRANTY}"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs sorted by their first member, that increases in the second too."""
    tails, ends, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        tails[at : at + 1] = [b]
        ends[at : at + 1] = [i]
        back.append(ends[at - 1] if at else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal ends need no anchors
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict = {}
        for i in range(b0, b1):
            once[b[i]] = -1 if b[i] in once else i
        mine: dict = {}
        for i in range(a0, a1):
            if once.get(a[i], -1) >= 0:
                mine[a[i]] = -1 if a[i] in mine else i
        spine = _increasing([(i, once[w]) for w, i in mine.items() if i >= 0])
        if spine:
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *spine], [*spine, (a1, b1)], strict=True):
                todo.append((i + 1, k, j + 1, m))
            out += spine
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], coverage: float):
        self.coverage = coverage
        self.templates = [(name, words_of(t)) for name, texts in templates.items() for t in texts]
        self.sets = [(name, t, frozenset(t)) for name, t in self.templates]
        self.vocabulary = frozenset(w for _, t in self.templates for w in t)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first and last word of the text) of the best notice of each license."""
        words = words_of(text)
        here = self.vocabulary.intersection(words)
        best: dict[str, tuple] = {}
        for name, template, distinct in self.sets:
            missing = len(distinct) - len(distinct & here)
            if len(template) - missing < self.coverage * len(template):
                continue
            places = [i for i, w in enumerate(words) if w in distinct]
            found = self._windows(places, [words[i] for i in places], template)
            share = len(found) / len(template)
            if share >= self.coverage and (name not in best or (len(found), share) > (best[name][2], best[name][1])):
                best[name] = (name, share, len(found), found[0], found[-1])
        out: list[tuple] = []
        for x in sorted(best.values(), key=lambda x: (-x[2], -x[1], x[0])):
            if all(x[4] < y[3] or x[3] > y[4] for y in out):  # a notice inside a longer one's span is part of it
                out.append(x)
        return out

    def _windows(self, places, words, template) -> list[int]:
        """Word positions of the best alignment: of the whole, or of a dense run of the template's words.

        A word that the text uses elsewhere too is not unique in the whole, but may be in a run; runs are
        cut where three or more other words lie between.
        """
        runs, start = [], 0
        for i in range(1, len(places) + 1):
            if i == len(places) or places[i] - places[i - 1] > 3:
                runs.append((start, i))
                start = i
        best: list[int] = [places[i] for i, _ in patience(words, template)]
        for a, b in runs:
            if b - a > len(best):
                got = [places[a + i] for i, _ in patience(words[a:b], template)]
                if len(got) > len(best) or len(got) == len(best) and got and got[-1] - got[0] < best[-1] - best[0]:
                    best = got
        return best


_SPAN = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("words", T.IntegerType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = 0.9) -> DataFrame:
    """docs' columns but text, with `licenses`: an array of (license, coverage, words, first_word, last_word).

    The notices found in the whole text with at least that coverage, the most words first; words count from
    0. Null and empty texts, and texts without a notice, have an empty array. A column of that name goes.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("text", "licenses")]
    base = docs.select(*own, utf8("text").alias("__text"))
    scanner = Scanner(templates or TEMPLATES, coverage)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("words", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

    def run(batches):
        names = ("license", "coverage", "words", "first_word", "last_word")
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in scanner.scan(t.decode("utf-8", "replace"))] for t in batch.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*own, "licenses"])

    return base.mapInArrow(run, T.StructType([*base.drop("__text").schema.fields, T.StructField("licenses", T.ArrayType(_SPAN))]))


def query(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    top = F.get("licenses", F.lit(0))
    return found.select("doc_id", top["license"].alias("license"), top["coverage"].alias("coverage"), top["words"].alias("matched_words"), top["first_word"].alias("first_word"), top["last_word"].alias("last_word"), F.size("licenses").alias("n_licenses"))
