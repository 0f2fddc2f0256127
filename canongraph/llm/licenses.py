"""Operator 7. Licence scans by patience alignment.

Method: words that occur once in a passage and once in a template are anchors; the longest increasing subsequence of
their places orders them, and the gaps between anchors are aligned the same way (where no such word is left, by the
longest common subsequence of the gap). The share of a template's words that are matched is its coverage. Passages are
the surroundings of the templates' rarest words, by frequencies counted over all documents: as many that a template covered
to ``least`` holds several.

Words are runs of letters and digits, A-Z lower-cased. Null and empty texts hold no licence; very long ones are searched
whole, long passages in overlapping windows. A document may hold several licences; of several passages for one template the
best counts, and of those that tie the first. Repeated rows and doc_ids, null ones too, give rows each. Empty tables and no templates give an empty
result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.llm.common import bound_batches, tidy
from canongraph.llm.decontam import Items, passages, rare_seeds

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Usual wordings of one-line notices, longer notices, and whole licences. Callers may pass templates of their own.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY,
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause text": _BSD_2 + _BSD_END,
    "BSD-3-Clause text": _BSD_2 + _BSD_3 + _BSD_END,
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def common_subsequence(a, b) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _rising(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, rising in both places; pairs come sorted by the first."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(places)
    for k, (_, j) in enumerate(places):
        x = bisect_left(tails, j)
        back[k] = at[x - 1] if x else -1
        tails[x : x + 1], at[x : x + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(places[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b) by patience alignment."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        once: list[dict] = []
        for words, x, y in ((a, i, i2), (b, j, j2)):
            places: dict = {}
            for k in range(x, y):
                places[words[k]] = -1 if words[k] in places else k
            once.append(places)
        anchors = _rising(sorted((k, once[1][w]) for w, k in once[0].items() if k >= 0 and once[1].get(w, -1) >= 0))
        if not anchors:
            out += [(i + x, j + y) for x, y in common_subsequence(a[i:i2], b[j:j2])]
            continue
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (i2, j2)]
        todo += [(p + 1, r, q + 1, t) for (p, q), (r, t) in zip(edges, edges[1:])]
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word) of templates covered to ``least`` or more."""
    bound_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    names = sorted(templates)
    items = Items(list(range(len(names))), [templates[n] for n in names], least)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((items, rare_seeds(docs, items), names))

    def run(batches):
        items, seeds, names = shared.value
        known = [w.tolist() for w in items.words]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            best: dict[tuple[int, int], tuple] = {}
            memo: dict[tuple[int, bytes], list] = {}
            for where, words in passages(batch.column(1), items, seeds, items.lengths // 4 + 5):
                for (doc, item, x), w in zip(where, words):
                    key = (item, w.tobytes())
                    if key not in memo:
                        memo[key] = patience(w.tolist(), known[item])
                    match = memo[key]
                    coverage = len(match) / len(known[item])
                    if coverage >= least and coverage > best.get((doc, item), (0.0,))[0]:
                        best[doc, item] = (coverage, x + match[0][0], x + match[-1][0])
            if best:
                rows = [(ids[doc], names[item], *v) for (doc, item), v in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    return docs.mapInArrow(tidy(run), "doc_id long, license string, coverage double, first_word long, last_word long")
