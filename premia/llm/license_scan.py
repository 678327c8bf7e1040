"""Operator 6: licences by patience alignment against a table of templates.

Words are lower-cased runs of letters and digits. A template is a short notice or a whole
licence; words between « and » are its name and must stand in the text together and whole, so
that no licence is named for another of its family. Region and template are aligned: words
unique to both are anchors, the longest increasing subsequence of their places is kept, equal
words next to anchors extend them, and the gaps between are aligned in the same way. Coverage
is the share of the template's words that are aligned; a licence is found from ``COVER`` on.

Where a region may lie: short templates (under ``LONG`` words) in a window of twice their words
in which at least ``COVER`` of as many words as they have are words of the template: no other
window can reach that coverage. Longer ones wherever ``SEED`` words in a row, unique in the
template, recur: the text is cut where the template starts anew, a part's seeds are chained by
their longest increasing subsequence, and only the gaps of the chain are aligned. A region of
a long template grows past any length, so a list of names inside a licence doesn't hide it; but
where seeds are more than twice the template apart, each side must hold a tenth of its words.
A text without one of a template's key words (a word of its name, or enough words that one
must be left at ``COVER``) or without its seeds cannot hold it and isn't aligned with it.

Whole texts are searched. Result: one row per licence found; where regions overlap, the
one of most aligned words (then coverage, the first, the first by name) stays. Cases: null, empty and
wordless texts and null ids give none; repeated rows repeat theirs; no documents or no templates give
none; null or wordless templates are left out; a table of templates over ``TABLE_BYTES`` is an error.
Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import textops

COVER = 0.8
LONG = 60                    # words from which on a template is found by seeds
SEED = 3
TABLE_BYTES = 64 << 20       # of a table of templates, which every task holds
# Notices (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the «Apache License, Version 2.0».",
    "CC-BY-NC-4.0": "Licensed under «CC BY-NC 4.0».",
    "CC-BY-4.0": "Licensed under «CC BY 4.0».",
    "CC-BY-SA-4.0": "Licensed under «CC BY-SA 4.0».",
    "GPL-3.0": "This work is licensed under the «GNU General Public License, version 3».",
    "MIT": "Released under the «MIT License».",
    "MPL-2.0": "This Source Code Form is subject to the terms of the «Mozilla Public License, v. 2.0».",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files, to deal in the Software without restriction",
}


# More notices and whole licences (fixed values); a licence may have several.
TEXTS = [
    *((f"CC-{kind}-{v}", f"Licensed under «CC {kind} {v}».") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")
      for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") if f"CC-{kind}-{v}" not in TEMPLATES),
    *((f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons «{name} {v} {place}» License.")
      for v, place in (("3.0", "Unported"), ("4.0", "International"))
      for kind, name in (("BY", "Commons Attribution"), ("BY-SA", "Commons Attribution-ShareAlike"),
                         ("BY-ND", "Commons Attribution-NoDerivatives"), ("BY-NC", "Commons Attribution-NonCommercial"),
                         ("BY-NC-SA", "Commons Attribution-NonCommercial-ShareAlike"),
                         ("BY-NC-ND", "Commons Attribution-NonCommercial-NoDerivatives"))),
    *((f"{short}-{v}", f"This program is free software: you can redistribute it and/or modify it under the terms of the "
       f"«GNU {name} General Public License» as published by the Free Software Foundation, either «version {v[:-2]}» "
       "of the License, or (at your option) any later version.")
      for short, name, v in (("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Lesser", "3.0"), ("AGPL", "Affero", "3.0"))),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the «GNU Lesser "
     "General Public License» as published by the Free Software Foundation; either «version 2.1» of the License, or (at your "
     "option) any later version."),
    ("GPL-2.0", "This work is licensed under the «GNU General Public License, version 2»."),
    ("Apache-2.0", "Licensed under the «Apache License, Version 2.0» (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
     "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
     "language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the «Mozilla Public License, v. 2.0». If a copy of the MPL "
     "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the «Boost Software License, Version 1.0»."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
     "this work under «CC0»."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
     "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
     "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the «above copyright notice and this permission notice appear in all copies». THE SOFTWARE IS "
     "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
     "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
     "SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without «fee is hereby "
     "granted. THE SOFTWARE IS PROVIDED» \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
     "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
     "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    *((name, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
       "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
       "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
       "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
       f"distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
       "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
       "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
       "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
       "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
       "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
       "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
      for name, third in (("BSD-2-Clause", ""), (
          "BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be «used to endorse "
          "or promote products» derived from this software without specific prior written permission. "))),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
     "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
     "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
     "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
     "original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
]


class Template:
    """Word hashes of a template, its names (ranges of words) and, for long ones, its unique seeds."""

    def __init__(self, name: str, text: str):
        parts = re.split("[«»]", text)
        self.name, self.hash, self.names = name, words_of(" ".join(parts)), []
        at = 0
        for i, part in enumerate(parts):
            n = len(words_of(part))
            if i % 2 and n:
                self.names.append((at, at + n))
            at += n
        self.words = self.hash.tolist()
        self.need = int(np.ceil(COVER * len(self.words)))
        self.long = len(self.words) >= LONG
        longest = np.argsort(-word_sizes(" ".join(parts)), kind="stable").tolist()
        if self.names:
            named = {i for a, b in self.names for i in range(a, b)}
            self.keys = {self.words[next(i for i in longest if i in named)]}
        else:
            self.keys = {self.words[i] for i in longest[:len(self.words) - self.need + 1]}
        self.seeds, self.seed_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if self.long:
            h = seeds(self.hash)
            once, at, n = np.unique(h, return_index=True, return_counts=True)
            self.seeds, self.seed_at = once[n == 1], at[n == 1]
            self.long = len(self.seeds) > 0     # none unique: found as a short one

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether all words of every name are aligned with words that stand together."""
        place = dict(pairs)
        return all(a in place and all(place.get(i) == place[a] + i - a for i in range(a, b)) for a, b in self.names)


def _words(text: str) -> textops.Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return textops.Words(raw, np.array([0, len(raw)]), textops.NOT_ALNUM)


def words_of(text: str) -> np.ndarray:
    return _words(text).hash


def word_sizes(text: str) -> np.ndarray:
    w = _words(text)
    return w.end - w.start


def seeds(h: np.ndarray) -> np.ndarray:
    """Hash of the SEED words from each word on."""
    n = max(0, len(h) - SEED + 1)
    out = np.zeros(n, np.uint64)
    for j in range(SEED):
        out = textops.mix(out * np.uint64(3) + h[j:j + n])
    return out


def built_in() -> list[tuple[str, str]]:
    return [*TEMPLATES.items(), *TEXTS]


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tops, at, back = [], [], []
    for i, x in enumerate(places):
        p = bisect_left(tops, x)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[p], at[p] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two word lists, in order."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = {}, {}
        for words, lo, hi, once in ((a, a0, a1, once_a), (b, b0, b1, once_b)):
            for i in range(lo, hi):
                once[words[i]] = -1 if words[i] in once else i
        both = [(i, once_b[w]) for w, i in once_a.items() if i >= 0 and once_b.get(w, -1) >= 0]
        both.sort()
        anchors = [both[i] for i in increasing([j for _, j in both])]
        ends = [*anchors, (a1, b1)]
        for (i, j) in ends if anchors else []:
            work.append((a0, i, b0, j))
            if i < a1:
                out.append((i, j))
            a0, b0 = i + 1, j + 1
    return sorted(out)


def holds(h: np.ndarray, run: np.ndarray) -> bool:
    """Whether the words of ``run`` stand together in a text."""
    at = np.flatnonzero(h[:max(0, len(h) - len(run) + 1)] == run[0])
    for d in range(1, len(run)):
        at = at[h[at + d] == run[d]]
    return len(at) > 0


def windows(h: np.ndarray, t: Template) -> list[tuple]:
    """(first word, pairs) of a short template's regions that reach the coverage, not overlapping."""
    out, n, free = [], len(t.words), 0
    at = np.flatnonzero(np.isin(h, t.hash))
    held = np.searchsorted(at, at + 2 * n) - np.arange(len(at))
    for s in at[held >= t.need].tolist():
        if s < free:
            continue
        pairs = align(t.words, h[s:s + 2 * n].tolist())
        if pairs and pairs[0][1] == 0 and len(pairs) >= t.need and t.named(pairs):
            free = s + pairs[-1][1] + 1
            out.append([(i, j + s) for i, j in pairs])
    return out


def chains(h: np.ndarray, hs: np.ndarray, t: Template) -> list[list[tuple[int, int]]]:
    """Aligned (template, text) places of a long template's regions that reach the coverage; ``hs``: the text's seeds."""
    out, n = [], len(t.words)
    if not len(hs):
        return out
    k = np.minimum(np.searchsorted(t.seeds, hs), len(t.seeds) - 1)
    at = np.flatnonzero(t.seeds[k] == hs)
    place = t.seed_at[k[at]]
    # A part starts where the template starts anew: at or before the place its first seed has.
    lo, starts = n, []
    for x, p in enumerate(place.tolist()):
        if p <= lo:
            lo = p
            starts.append(x)
    for x0, x1 in zip(starts, [*starts[1:], len(at)]):
        i, j = place[x0:x1].tolist(), at[x0:x1].tolist()
        chain = [(i[x], j[x]) for x in increasing(i)]
        # Sides more than twice the template apart count if each holds a tenth of its words.
        cuts = [0, *[x for x in range(1, len(chain)) if chain[x][1] - chain[x - 1][1] > 2 * n], len(chain)]
        sides = [chain[a:b] for a, b in zip(cuts, cuts[1:])]
        chain = [p for side in sides if len({a + d for a, _ in side for d in range(SEED)}) * 10 >= n for p in side]
        if not chain:
            continue
        first = max(0, chain[0][1] - 2 * chain[0][0])
        end = min(len(h), chain[-1][1] + SEED + 2 * (n - chain[-1][0] - SEED))
        pairs, a0, b0 = [], 0, first
        for a, b in [*chain, (n, end)]:
            if a < a0 or b < b0:            # seeds that overlap: one chain of words
                continue
            if a > a0 and b > b0:
                pairs += [(u + a0, v + b0) for u, v in align(t.words[a0:a], h[b0:b].tolist())]
            if a < n:
                pairs += [(a + d, b + d) for d in range(SEED)]
            a0, b0 = a + SEED, b + SEED
        if len(pairs) >= t.need and t.named(pairs):
            out.append(pairs)
    return out


def apart(found: list[tuple]) -> list[tuple]:
    """Of (name, coverage, first, end, aligned) rows the best ones that don't overlap, by place."""
    begins, ends, best = [], [], []
    for x in sorted(found, key=lambda x: (-x[4], -x[1], x[2], x[0])):
        k = bisect_left(begins, x[3])       # kept rows do not overlap, so only the last one that begins before x ends can
        if k and ends[k - 1] > x[2]:
            continue
        begins.insert(k, x[2])
        ends.insert(k, x[3])
        best.append(x)
    return [x[:4] for x in sorted(best, key=lambda x: x[2:])]


def notices(h: np.ndarray, templates: list[Template]) -> list[tuple]:
    """(name, coverage, first word, end word) of the licences in a text's word hashes."""
    hs = seeds(h) if any(t.long for t in templates) else h[:0]
    found = []
    for t in templates:
        if not all(holds(h, t.hash[a:b]) for a, b in t.names):
            continue
        for pairs in chains(h, hs, t) if t.long else windows(h, t):
            found.append((t.name, len(pairs) / len(t.words), pairs[0][1], pairs[-1][1] + 1, len(pairs)))
    return apart(found)


def likely(w: textops.Words, templates: list[Template]) -> dict[int, list[int]]:
    """Per text the templates whose key words (and, for long ones, seeds) it holds."""
    owner = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))

    def meet(values: np.ndarray, keys: list) -> np.ndarray:
        """Text * templates + template of every pair that shares a value."""
        flat = np.array([x for k in keys for x in k], np.uint64)
        of = np.array([i for i, k in enumerate(keys) for _ in k], np.int64)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        sieve = np.zeros(1 << 16, bool)
        sieve[(flat & np.uint64(0xFFFF)).astype(np.int64)] = True
        hit = np.flatnonzero(sieve[(values & np.uint64(0xFFFF)).astype(np.int64)])
        a, b = (np.searchsorted(flat, values[hit], side) for side in ("left", "right"))
        hit, a, per = hit[b > a], a[b > a], (b - a)[b > a]
        which = of[np.repeat(a - np.cumsum(per) + per, per) + np.arange(per.sum())]
        return np.unique(np.repeat(owner[hit], per) * len(templates) + which)

    keyed = meet(w.hash, [t.keys for t in templates])
    long = np.array([t.long for t in templates])[keyed % len(templates)]
    if long.any():
        keyed = keyed[~long | np.isin(keyed, meet(seeds(w.hash), [t.seeds.tolist() if t.long else [] for t in templates]))]
    out: dict[int, list[int]] = {}
    for x in keyed.tolist():
        out.setdefault(x // len(templates), []).append(x % len(templates))
    return out


_SCHEMA = "doc_id long, license string, coverage double, start_word long, end_word long"


def template_table(table: DataFrame) -> list[tuple[str, str]]:
    """Rows of a table of templates (license, text) that every task can hold."""
    rows = table.where("license is not null and text is not null").select("license", "text")
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > TABLE_BYTES:
        raise ValueError(f"templates of more than {TABLE_BYTES} bytes")
    return [tuple(r) for r in rows.distinct().collect()]


def scan(docs: DataFrame, templates: dict[str, str] | list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """Licences of all documents against the templates: texts by name, pairs, or a table (license, text)."""
    if isinstance(templates, DataFrame):
        templates = template_table(templates)
    elif isinstance(templates, dict):
        templates = list(templates.items())
    table = [Template(k, v) for k, v in (built_in() if templates is None else templates)]
    table = sorted((t for t in table if t.words), key=lambda t: t.name)

    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                w = textops.Words(*textops.text_buffers(b.column("text")), textops.NOT_ALNUM)
                found = []
                for i, some in (likely(w, table) if table else {}).items():
                    found += [(i, *x) for x in notices(w.hash[w.off[i]:w.off[i + 1]], [table[k] for k in some])]
                ids = b.column("doc_id").to_pylist()
                found = [(ids[x[0]], *x[1:]) for x in found if ids[x[0]] is not None]
                cols = list(zip(*found, strict=True)) if found else [()] * 5
                types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, _SCHEMA)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
