"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

A template may stand in a text with words put in: a match is a passage of at most `SPREAD` times the
template's words that holds the wanted share of its shingles. (A template that is too short to be split
and keep that share stands in one piece.) Templates are grouped by length. For a group, a text is covered
by overlapping windows, each a quarter of a template after the one before, so long that any such passage
lies whole in some window. From the containment to be found follows the least Jaccard similarity of such
a window and its template, and from that the number of bands under which they share one with the wanted
probability. Shared bands only name candidates: a match needs the containment itself, counted on the
full sets of 5-word shingles over passages of the windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import ALNUM_LOWER, LOWER, blocks, hashes, ranges, sequence_hashes, split

#: Words in a shingle, the share of a template's shingles that a match needs, the chance to miss one.
SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-5
#: Values in a band. A shared minimum is already a shared run of 5 words, which is rare outside of a
#: match; longer bands would need several times as many hash evaluations for the same chance to miss.
BAND_ROWS = 1
#: How many times a template's own words the passage may have that it is found in.
SPREAD = 3
#: Words in a block, the unit in which windows begin and end; templates of a group differ by this factor.
BLOCK, GROUP_FACTOR = 2, 1.35

# Short notices, and notices, grants and disclaimers of public licenses as their stewards publish them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of digits, letters and bytes beyond ASCII, after lower-casing A-Z, and their bounds."""
    low = LOWER[data]
    starts, ends, first = split(low, offsets, ALNUM_LOWER)
    return hashes(low, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 5 words each, and where each text's begin; a shorter text with words is one shingle."""
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    at = ranges(first[:-1], count)
    width = np.repeat(np.minimum(n, SHINGLE), count)
    return sequence_hashes(words, at, at + width), np.concatenate(([0], np.cumsum(count)))


def bands_needed(similarity: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands of `rows` values under which two sets of this similarity share none with a chance of `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**rows))))


@dataclass(frozen=True)
class Group:
    """Templates of about one length: (number, shingle set, shingles that a match spans at most), cells in a
    window, blocks in a cell, and of each band the values of its templates."""

    numbers: list[int]
    sets: list[np.ndarray]
    reach: list[int]
    window: int
    step: int
    keys: list[list[tuple[int, ...]]]


class Scanner:
    """Templates and the hash functions to look for them."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT):
        self.names = [name for name, _ in templates]
        self.containment = containment
        batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in templates], pa.string())})
        sets: list[np.ndarray] = []
        spans: list[int] = []
        for part, data, offsets in blocks(batch):
            words, first = normal_words(data, offsets)
            own, bounds = shingles(words, first)
            sets += [np.unique(own[bounds[i] : bounds[i + 1]]) for i in range(part.num_rows)]
            spans += np.diff(first).tolist()
        # Words put in cost a template the SHINGLE - 1 shingles across that place.
        splits = [len(x) - math.ceil(containment * len(x) - 1e-9) >= SHINGLE - 1 for x in sets]
        reach = [max(1, n * (SPREAD if split_ else 1) - SHINGLE + 1) for n, split_ in zip(spans, splits, strict=True)]
        order = [i for i in sorted(range(len(sets)), key=lambda i: len(sets[i])) if len(sets[i])]
        drafts: list[list[int]] = []
        for i in order:
            if drafts and splits[i] == splits[drafts[-1][0]] and len(sets[i]) <= max(len(sets[drafts[-1][0]]) * GROUP_FACTOR, len(sets[drafts[-1][0]]) + 1):
                drafts[-1].append(i)
            else:
                drafts.append([i])
        self.groups, shapes = [], []
        for members in drafts:
            step = max(1, len(sets[members[-1]]) // 4 // BLOCK)
            # A passage begins anywhere in its first cell.
            window = -(-(max(reach[m] for m in members) - 1) // (step * BLOCK)) + 1
            shared = {m: math.ceil(containment * len(sets[m]) - 1e-9) for m in members}
            least = min(shared[m] / (window * step * BLOCK + len(sets[m]) - shared[m]) for m in members)
            shapes.append((members, window, step, bands_needed(least)))
        n_bands = max((s[3] for s in shapes), default=0)
        draw = np.random.Generator(np.random.PCG64(17))
        self.factor = draw.integers(0, 1 << 32, n_bands * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
        self.add = draw.integers(0, 1 << 32, n_bands * BAND_ROWS, dtype=np.uint32)
        for members, window, step, bands in shapes:
            upper = [self.upper(sets[m]) for m in members]
            keys = [sorted({tuple(int(self.values(u, b * BAND_ROWS + r).min()) for r in range(BAND_ROWS)) for u in upper}) for b in range(bands)]
            self.groups.append(Group(members, [sets[m] for m in members], [reach[m] for m in members], window, step, keys))

    @staticmethod
    def upper(members: np.ndarray) -> np.ndarray:
        """The half of a shingle's hash that bands are made from."""
        return (members >> np.uint64(32)).astype(np.uint32)

    def values(self, upper: np.ndarray, i: int) -> np.ndarray:
        """The i-th hash of every shingle."""
        y = upper * self.factor[i]
        y += self.add[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        return y

    def candidates(self, members: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(text, first shingle, end shingle, group) of the windows that share a band with a template of a group.

        Windows of a text that overlap are given as one.
        """
        full = np.flatnonzero(np.diff(bounds))
        edge = np.append(bounds[:-1][full], bounds[-1])
        per_text = -(-np.diff(edge) // BLOCK)
        if not len(full):
            return []
        block_of = np.concatenate(([0], np.cumsum(per_text)))
        begin = edge[:-1][np.repeat(np.arange(len(full)), per_text)] + ranges(np.zeros(len(full), dtype=np.int64), per_text) * BLOCK
        cells, hit, short = [], [], []
        for g in self.groups:
            n = -(-per_text // g.step)
            cells.append((n, np.repeat(block_of[:-1], n) + ranges(np.zeros(len(full), dtype=np.int64), n) * g.step))
            hit.append(np.zeros(max(int(n.sum()) - g.window + 1, 0), dtype=bool))
            short.append(np.zeros(len(full), dtype=bool))
        upper = self.upper(members)
        for b in range(max(len(g.keys) for g in self.groups)):
            lows = [np.minimum.reduceat(self.values(upper, b * BAND_ROWS + r), begin) for r in range(BAND_ROWS)]
            whole = [np.minimum.reduceat(x, block_of[:-1]) for x in lows]
            for k, g in enumerate(self.groups):
                if b >= len(g.keys):
                    continue
                least = [self._least(np.minimum.reduceat(x, cells[k][1]) if g.step > 1 else x, g.window) for x in lows]
                for key in g.keys[b]:
                    hit[k] |= np.logical_and.reduce([x == v for x, v in zip(least, key, strict=True)])
                    short[k] |= np.logical_and.reduce([x == v for x, v in zip(whole, key, strict=True)])
        out = []
        for k, g in enumerate(self.groups):
            n = cells[k][0]
            cell_of = np.concatenate(([0], np.cumsum(n)))
            at = np.flatnonzero(hit[k])
            t = np.searchsorted(cell_of, at, side="right") - 1
            inside = at + g.window <= cell_of[1:][t]
            at, t = at[inside], t[inside]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (t[1:] != t[:-1]) | (at[1:] > at[:-1] + g.window)
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(at))[: len(head)] - 1
            last = np.minimum(cells[k][1][at[tail]] + g.window * g.step, block_of[1:][t[tail]]) - 1
            # A text of fewer cells than a window is one.
            small = np.flatnonzero(short[k] & (n < g.window))
            texts = np.concatenate((t[head], small))
            low = np.concatenate((begin[cells[k][1][at[head]]], edge[:-1][small]))
            high = np.concatenate((np.minimum(begin[last] + BLOCK, edge[1:][t[tail]]), edge[1:][small]))
            if len(texts):
                out.append((full[texts], low, high, k))
        return out

    @staticmethod
    def _least(x: np.ndarray, window: int) -> np.ndarray:
        """The least value of every run of `window` entries."""
        if len(x) < window:
            return x[:0]
        width = 1
        while 2 * width <= window:
            x = np.minimum(x[:-width], x[width:])
            width *= 2
        return np.minimum(x[: len(x) - (window - width)], x[window - width :])

    @staticmethod
    def _best(at: np.ndarray, which: np.ndarray, reach: int) -> tuple[int, int, int]:
        """(different shingles, first, last) of the first passage of at most `reach` shingles with most different ones.

        `at` holds the places of a template's shingles, `which` which ones they are.
        """
        places, kinds = at.tolist(), which.tolist()
        held: dict[int, int] = {}
        best, left = (0, 0, 0), 0
        for place, kind in zip(places, kinds, strict=True):
            held[kind] = held.get(kind, 0) + 1
            while place - places[left] >= reach or held[kinds[left]] > 1:
                held[kinds[left]] -= 1
                if not held[kinds[left]]:
                    del held[kinds[left]]
                left += 1
            if len(held) > best[0]:
                best = (len(held), places[left], place)
        return best

    def _all(self, at: np.ndarray, which: np.ndarray, reach: int, wanted: int) -> list[tuple[int, int, int]]:
        """(different shingles, first, last) of passages that match and do not overlap: the best one, then those on either side."""
        out, parts = [], [(at, which)]
        while parts:
            at, which = parts.pop()
            if len(at) < self.containment * wanted - 1e-9:
                continue
            n, first, last = self._best(at, which, reach)
            if n < self.containment * wanted - 1e-9:
                continue
            out.append((n, first, last))
            for side in (at <= first - SHINGLE, at >= last + SHINGLE):
                parts.append((at[side], which[side]))
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, int, float]]]]:
        """Words of each text, and its matches (template, first word, end word, containment), in order; those of one template do not overlap."""
        words, first = normal_words(data, offsets)
        members, bounds = shingles(words, first)
        found: list[dict[int, list[tuple[int, int, float]]]] = [{} for _ in range(len(offsets) - 1)]
        for texts, lows, highs, k in self.candidates(members, bounds):
            g = self.groups[k]
            for t, low, high in zip(texts.tolist(), lows.tolist(), highs.tolist(), strict=True):
                own = members[low:high]
                for number, wanted, reach in zip(g.numbers, g.sets, g.reach, strict=True):
                    which = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    at = np.flatnonzero(wanted[which] == own)
                    for n, head, last in self._all(at, which[at], reach, len(wanted)):
                        start = low - bounds[t] + head
                        end = min(low - bounds[t] + last + SHINGLE, int(first[t + 1] - first[t]))
                        found[t].setdefault(number, []).append((int(start), int(end), n / len(wanted)))
        return np.diff(first), [[(n, *m) for n, own in sorted(x.items()) for m in sorted(own)] for x in found]


def _run(shared, columns: int):  # noqa: ANN001, ANN202
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = shared.value
        for batch in batches:
            for part, data, offsets in blocks(batch, "__text"):
                n_words, found = scanner.scan(data, offsets)
                matches = [[{"license": scanner.names[n], "first_word": s, "end_word": e, "containment": c} for n, s, e, c in x] for x in found]
                arrays = [part.column(i) for i in range(columns)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_words, pa.int64()), pa.array(matches, kind)], names=[*part.schema.names[:columns], "__n", "__matches"])

    return run


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """`docs` with n_words and matches (license, first_word, end_word, containment), all that do not overlap of each template.

    A text of fewer than 5 words is one shingle, as is such a template. Nulls and empty texts match
    nothing; rows that repeat match alike. Columns of the input with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, containment))  # the catalogue, not data
    plain = docs.drop("n_words", "matches")
    named = plain.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(plain.columns)], F.col("text").alias("__text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    out = named.mapInArrow(_run(shared, len(plain.columns)), f"{schema}, __n long, __matches array<struct<license:string,first_word:int,end_word:int,containment:double>>")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(plain.columns)], F.col("__n").alias("n_words"), F.col("__matches").alias("matches"))


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: words, the different licenses (sorted, comma-joined), their number, the best containment.

    Null and empty texts have no words and match nothing; repeated rows and empty tables as in `scan_licenses`.
    """
    found = scan_licenses(docs.select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
    )
