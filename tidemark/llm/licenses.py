"""Licence scans: normalised text against templates by Dice coefficient over word bigrams, sizes pruning templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import over
from tidemark.llm.textkernel import NON_ALNUM, SPACE, mix, text_slices, words

#: A unit (a line, a block of lines between blank ones, the whole text, or a run of its words) matches a template at this Dice coefficient.
THRESHOLD = 0.9

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Fixed values: (licence, template). Several templates may name one licence.
TEMPLATES = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD2} {_BSD3} {_BSD_END}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)

_K = np.uint64(0x2545F4914F6CDD1D)


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram hashes of each unit and where each unit's start; a unit of one word has none."""
    counts = np.maximum(np.diff(first) - 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    unit = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(at[-1]) - at[unit] + first[unit]
    return mix(hashes[place] * _K + hashes[np.minimum(place + 1, max(len(hashes) - 1, 0))]), at


class Templates:
    def __init__(self, rows: tuple[tuple[str, str], ...], threshold: float) -> None:
        self.names = [name for name, _ in rows]
        self.threshold = threshold
        _, data, offsets = next(text_slices(pa.array([text for _, text in rows]), 1 << 62))
        hashes, first, _ = words(data, offsets, NON_ALNUM)
        values, at = _pairs(hashes, first)
        sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.sizes = np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.values, self.owner = every[order], owner[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.values >> np.uint64(48)).astype(np.int64)] = True

    def match(self, values: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """(unit, template, Dice) of each unit's best template at the threshold or over; ties go to the first template.

        A template of b bigrams is a candidate for a unit of a only if 2 * min(a, b) >= threshold * (a + b).
        """
        unit_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        hit = np.flatnonzero(self.maybe[(values >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.values, values[hit], "left"), np.searchsorted(self.values, values[hit], "right")
        units = np.unique(unit_of[hit[hi > lo]])
        out = []
        for unit in units.tolist():
            mine = np.unique(values[at[unit] : at[unit + 1]])
            fits = np.flatnonzero(2 * np.minimum(len(mine), self.sizes) >= self.threshold * (len(mine) + self.sizes))
            if not len(fits):
                continue
            a, b = np.searchsorted(self.values, mine, "left"), np.searchsorted(self.values, mine, "right")
            count = b - a
            which = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            common = np.bincount(self.owner[which], minlength=len(self.sizes))
            dice = 2 * common[fits] / (len(mine) + self.sizes[fits])
            if dice.max() >= self.threshold:
                out.append((unit, int(fits[dice.argmax()]), float(dice.max())))
        return out

    def runs(self, values: np.ndarray, at: np.ndarray, floor: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, template, Dice, first and last bigram) of each text's best run of words, if it reaches the threshold and exceeds the text's floor.

        A run reaches it only with threshold / (2 - threshold) of a template's bigrams; texts that hold fewer are not searched.
        """
        many, n = len(self.sizes), len(self.values)
        hit = np.flatnonzero(self.maybe[(values >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.values, values[hit], "left"), np.searchsorted(self.values, values[hit], "right")
        count = hi - lo
        if not count.sum():
            return []
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        place, owner = np.repeat(hit, count), self.owner[entry]
        text_of = np.searchsorted(at, place, "right") - 1
        held = np.unique(text_of * n + entry)
        common = np.bincount(held // n * many + self.owner[held % n], minlength=(len(at) - 1) * many).reshape(-1, many)
        able = (common > 0) & (common >= self.threshold * self.sizes / (2 - self.threshold) - 1e-9) & (2 * common > floor[:, None] * (common + self.sizes))
        out = []
        for text in np.flatnonzero(able.any(axis=1)).tolist():
            a, b = int(at[text]), int(at[text + 1])
            mine = values[a:b]
            order = np.argsort(mine, kind="stable")
            again = np.flatnonzero(mine[order[1:]] == mine[order[:-1]])
            before, after = np.full(b - a, -1), np.full(b - a, b - a)
            before[order[again + 1]], after[order[again]] = order[again], order[again + 1]
            here = slice(*np.searchsorted(place, [a, b]))
            best, found = floor[text], None
            for template in np.flatnonzero(able[text]).tolist():
                inside = np.zeros(b - a, bool)
                inside[place[here][owner[here] == template] - a] = True
                run = _best_run(before, after, inside, int(self.sizes[template]), self.threshold, best)
                if run:
                    best, found = run[0], (text, template, *run)
            if found:
                out.append(found)
        return out


def _best_run(before: np.ndarray, after: np.ndarray, inside: np.ndarray, size: int, threshold: float, floor: float) -> tuple[float, int, int] | None:
    """(Dice, first, last) of the run of bigrams most like a template of `size` bigrams, at the threshold and over the floor; `inside` marks the template's, `before` and `after` name the same bigram's neighbours.

    A best run starts with a bigram of the template that it does not repeat, and has at most size * (2 - threshold) / threshold distinct ones.
    """
    most = int(size * (2 - threshold) / threshold + 1e-9)
    out = None
    for first in np.flatnonzero(inside).tolist():
        end, start, distinct, common = int(after[first]), first, 0, 0
        while start < end and distinct <= most:
            stop = min(start + 2 * most + 1, end)
            new = before[start:stop] < first
            a, c = distinct + np.cumsum(new), common + np.cumsum(new & inside[start:stop])
            dice = 2 * c / (a + size)
            k = int(dice.argmax())
            if dice[k] >= threshold and dice[k] > floor:
                floor = float(dice[k])
                out = (floor, first, start + k)
            start, distinct, common = stop, int(a[-1]), int(c[-1])
        if floor >= 1:
            break
    return out


def _units(data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, starts of units with the end of the last, row of each) by lines, blocks of lines, and whole texts. Lines of white space only are blank."""
    breaks = np.flatnonzero(data == 10)
    lines = np.unique(np.concatenate([offsets, breaks + 1]))
    filled = np.searchsorted(np.flatnonzero(~SPACE[data]), breaks)
    double = breaks[1:][np.diff(filled) == 0]
    blocks = np.unique(np.concatenate([offsets, double + 1]))
    out = []
    for kind, edges in (("line", lines), ("block", blocks), ("text", np.unique(offsets))):
        out.append((kind, edges, np.searchsorted(offsets, edges[:-1], "right") - 1))
    return out


def _scan(rows: tuple[tuple[str, str], ...], threshold: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(rows, threshold)
        for batch in batches:
            for start, data, offsets in text_slices(batch.column(1)):
                n = len(offsets) - 1
                best: list[tuple] = [(0.0, None, None, None, None)] * n
                sizes = np.zeros(n, np.int64)
                for kind, edges, row_of in _units(data, offsets):
                    hashes, first, begins = words(data, edges, NON_ALNUM)
                    values, at = _pairs(hashes, first)
                    if kind == "text":
                        sizes[row_of] = np.diff(at)
                    for unit, template, dice in templates.match(values, at):
                        row = int(row_of[unit])
                        if dice > best[row][0]:
                            best[row] = (dice, templates.names[template], kind, int(edges[unit] - offsets[row]), int(edges[unit + 1] - offsets[row]))
                # the last kind was the whole text
                for unit, template, dice, lo, hi in templates.runs(values, at, np.array([best[row][0] for row in row_of])):
                    row, word = int(row_of[unit]), int(first[unit])
                    a, z = int(begins[word + lo]), int(begins[word + hi + 1])
                    gap = np.flatnonzero(NON_ALNUM[data[z : edges[unit + 1]]])
                    end = z + int(gap[0]) if len(gap) else int(edges[unit + 1])
                    best[row] = (dice, templates.names[template], "run", a - int(offsets[row]), end - int(offsets[row]))
                dice, name, kind, lo, hi = zip(*best, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array(sizes), pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(kind, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                    names=["doc_id", "n_bigrams", "license", "dice", "unit", "first_byte", "end_byte"],
                )

    return run


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's best licence: doc_id, n_bigrams of its text (with repeats), license, dice, unit (line, block, text or run) and the unit's bytes; license null and dice 0 if no unit reaches the threshold.

    Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased. Lines, blocks of
    lines between blank ones, the whole text and every run of consecutive words of it are
    compared, each as its set of word bigrams, so that a licence of several paragraphs or inside
    a longer text or line is found. Of equal coefficients the line, then the block, the text and
    the run wins; of equal units the earlier one, then the earlier template; of equal runs the
    earlier template, then the earlier and shorter run.
    No shuffle; templates go with the task.

    Null and empty texts, and texts of one word: no licence. Null and repeated ids: rows as they
    come. Empty tables: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return over(rows, _scan(templates, threshold), "doc_id long, n_bigrams long, license string, dice double, unit string, first_byte long, end_byte long")
