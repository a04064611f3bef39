"""Licence scans: Dice coefficient of word bigrams between templates and parts of documents.

Words are runs of letters and digits, in lower case; lines play no part, so a notice is found
inside a longer line and over several. Every window of words is compared with every template
as multisets of word bigrams, and two bounds on sizes leave out windows that can't reach the
coefficient t, without loss:

* A template of n bigrams reaches t only with windows of m bigrams, n * t / (2 - t) <= m <=
  n * (2 - t) / t, that share at least n * t / (2 - t) bigrams with it. So a start is tried
  only if so many bigrams of the template stand within the longest window from there, and a
  template only if the whole text holds so many.
* Cutting a bigram that isn't shared off a window raises its coefficient, so only windows that
  begin and end with a bigram of the template are compared.

The work for a text is bounded by its words times the length of the templates it nearly holds.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
WORD = re.compile(r"[^\W_]+")

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_AS_IS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'


def _gnu(name: str, version: str, mark: str) -> str:
    return f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{',' if mark == ':' else ';'} either version {version} of the License, or (at your option) any later version."


def _cc(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License."


#: The notices by which texts state a licence and the whole texts of the short licences, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "0BSD": [f"{_ISC_GRANT}. {_ISC_AS_IS}"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _gnu("GNU Affero General Public License", "3", ":")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, _APACHE_AS_IS, f"{_APACHE} {_APACHE_AS_IS}"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_AS_IS}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _BSD_GRANT, f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_AS_IS}"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _cc("Attribution")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _cc("Attribution-NonCommercial")],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", _cc("Attribution-NonCommercial-NoDerivatives")],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", _cc("Attribution-NonCommercial-ShareAlike")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _cc("Attribution-NoDerivatives")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _cc("Attribution-ShareAlike")],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _gnu("GNU General Public License", "2", ";")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _gnu("GNU General Public License", "3", ":")],
    "ISC": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("GNU Lesser General Public License", "2.1", ";")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("GNU Lesser General Public License", "3", ":")],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT_GRANT, f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"],
    "MPL-1.1": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
}


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def bigrams(w: list[str]) -> Counter:
    return Counter(zip(w, w[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """Templates ready to search texts; words and bigrams of all of them have numbers."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST):
        self.least = least
        self.items = [(name, k, bigrams(words(t))) for name, ts in templates.items() for k, t in enumerate(ts)]
        self.number = {w: n for n, w in enumerate(dict.fromkeys(w for _, _, b in self.items for pair in b for w in pair), 1)}
        base = len(self.number) + 1
        codes = sorted({self.number[x] * base + self.number[y] for _, _, b in self.items for x, y in b})
        self.base, self.codes = base, np.array(codes, np.int64)
        place = {c: i for i, c in enumerate(codes)}
        self.counts = np.zeros((len(self.items), len(codes)), np.int64)
        for n, (_, _, b) in enumerate(self.items):
            for (x, y), c in b.items():
                self.counts[n, place[self.number[x] * base + self.number[y]]] = c
        self.sizes = self.counts.sum(1)
        self.need = np.ceil(self.sizes * least / (2 - least) - 1e-9).astype(np.int64)
        self.longest = np.floor(self.sizes * (2 - least) / least + 1e-9).astype(np.int64)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, start, end, coefficient) of the notices in a text, in code points.

        From each word the best window of each template (the shorter one of two as good). Of windows
        that overlap, the one that shares most bigrams is kept, then the one of the higher
        coefficient, then the earlier and shorter; the same window of several licences, as good, is
        kept for each.
        """
        if not text:
            return []
        get = self.number.get
        said = np.array([get(w, 0) for w in words(text)], np.int64)
        if len(said) < 2:
            return []
        code = np.where((said[:-1] > 0) & (said[1:] > 0), said[:-1] * self.base + said[1:], -1)
        known = np.flatnonzero(code >= 0)
        which = np.minimum(np.searchsorted(self.codes, code[known]), len(self.codes) - 1)
        hit = self.codes[which] == code[known]
        at, which = known[hit], which[hit]
        if not len(at):
            return []
        held = np.minimum(self.counts, np.bincount(which, minlength=len(self.codes))).sum(1)
        found = []
        for n in np.flatnonzero(held >= self.need).tolist():
            mine = self.counts[n, which] > 0
            found += [(-c, -score, i, j, self.items[n][0]) for c, score, i, j in self._windows(n, at[mine], which[mine])]
        if not found:
            return []
        kept: list[tuple] = []
        firsts: list[int] = []  # of the windows kept, which are apart, with their last words
        lasts: list[int] = []
        same: set[tuple] = set()
        for x in sorted(found):
            i, j = x[2], x[3]
            k = bisect.bisect_left(lasts, i)
            if k == len(firsts) or firsts[k] > j:
                firsts.insert(k, i)
                lasts.insert(k, j)
                same.add(x[:4])
                kept.append(x)
            elif x[:4] in same and x[4] != kept[-1][4]:
                kept.append(x)
        spans = [m.span() for m in WORD.finditer(text)]
        return sorted(((name, spans[i][0], spans[j][1], -score) for _, score, i, j, name in kept), key=lambda r: (r[1], r[2], r[0]))

    def _windows(self, n: int, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(shared, coefficient, first word, last word) of the best window from each start."""
        need, longest, size, counts = int(self.need[n]), int(self.longest[n]), int(self.sizes[n]), self.counts[n]
        if len(at) < need:
            return
        starts = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < longest)
        where, kinds = at.tolist(), which.tolist()
        for s in starts.tolist():
            seen: dict[int, int] = {}
            shared, best = 0, None
            for k in range(s, len(where)):
                m = where[k] - where[s] + 1
                if m > longest:
                    break
                kind = kinds[k]
                seen[kind] = seen.get(kind, 0) + 1
                if seen[kind] > counts[kind]:
                    continue
                shared += 1
                score = 2 * shared / (m + size)
                if score >= self.least and (best is None or score > best[1]):
                    best = (shared, score, where[s], where[k] + 1)
            if best:
                yield best


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, licence, start, end, dice): every stated licence of every row, its place in code points.

    Null and empty texts and texts of one word state none; repeated rows repeat their findings;
    other columns play no part. A text may state several licences; see :meth:`Templates.scan` for
    windows that overlap. A template of one word states nothing.
    """
    chosen = templates or TEMPLATES

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = Templates(chosen, least)
        for batch in batches:
            rows = [(i, *r) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in t.scan(x)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "licence", "start", "end", "dice"])

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("whole"))
    return kept.mapInArrow(search, "doc_id long, licence string, start long, end long, dice double")
