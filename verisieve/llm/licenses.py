"""License scan by conditional compression.

Candidate blocks are the surroundings of license vocabulary, wide enough to hold every
template around its own vocabulary however its lines are wrapped; surroundings that touch
are one block. A block is compressed alone and with each template as a zstandard raw
dictionary, and the templates are ranked by how much smaller it gets. The first of them that the
wording confirms tells where a notice stands. There, with a few words around, the templates are
ranked again, as what surrounds a notice compresses a little better or worse by chance; the first of
those that save anything and that the wording confirms is the notice (of those within ``CLOSE``
bytes of it the one with the fewest differing words): the stretch of the block with the most agreeing words over
differing ones, if at least ``least_share`` of the template's words and of the stretch's
agree and, of a wording of fewer than ``SHORT`` words, none is lacking that only this
license's wordings use. What stands before and
after a notice is ranked again by itself, so every notice of a block is reported, with the
exact words that it lacks or adds.

Whole texts are searched. Null and empty texts have no blocks; an empty table
gives no rows; repeated rows give repeated results; ties go to the template that
comes first. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm.common import table, tune
from verisieve.llm.textvec import LOWER, WS, pieces

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'

_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: (SPDX identifier, wording): short notices and the opening terms of the common licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ' + _BSD_WARRANTY),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ' + _BSD_WARRANTY),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("Proprietary", "All rights reserved."),
)

STEMS = (b"licen", b"copyright", b"warrant", b"spdx", b"redistribut", b"hereby granted", b"public domain", b"rights reserved", b"creative commons", b"merchantab", b"free software", b"permission notice", b"without restriction", b"as is")

#: Wordings of fewer words must hold what sets their license apart.
SHORT = 12
#: Words on each side of a notice that are ranked with it.
AROUND = 4
#: Bytes that one short word (a version's number) is worth to the compressor; of templates that save
#: so nearly the same the wording decides.
CLOSE = 4

SCHEMA = "doc_id long, block long, block_start long, block_end long, license string, template long, plain_bytes long, conditional_bytes long, saving double, words_lacking long, words_added long, difference string, exact boolean"
_word = re.compile(r"[\w.+-]*\w")


def vocabulary(text: str) -> list[str]:
    return _word.findall(text.lower())


class Scanner:
    """Compressors for each template; one per Python worker task. From level 16 on zstandard parses
    optimally; below, sizes of short texts jump by ten bytes and more."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least_share: float, level: int = 16):
        self.templates, self.least_share = templates, least_share
        params = zstandard.ZstdCompressionParameters.from_level(level, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        self.given = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.words = [vocabulary(t) for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        others = [set().union(*(w for w, (name, _) in zip(self.counts, templates, strict=True) if name != mine)) for mine, _ in templates]
        self.needed = [set(w) - o if len(w) < SHORT else set() for w, o in zip(self.words, others, strict=True)]
        self.known: dict[str, list[tuple]] = {}

    def notices(self, block: str) -> list[tuple]:
        """(license, template, plain, conditional, saving, lacking, added, difference, exact) of each notice, in order."""
        if block not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            places = [(m.start(), m.end()) for m in _word.finditer(block)]
            mine = [block[a:b].lower() for a, b in places]
            out, todo = [], [(0, len(mine))]
            while todo:
                lo, hi = todo.pop()
                got = self._best(block, places[lo:hi], mine[lo:hi])
                if got:
                    first, last, row = got
                    out.append((lo + first, row))
                    todo += [(lo, lo + first), (lo + last, hi)]
            self.known[block] = [row for _, row in sorted(out)]
        return self.known[block]

    def _ranked(self, text: str) -> list[tuple[int, int]]:
        """(bytes saved, template), the template that saves most first."""
        raw = " ".join(text.split()).encode()
        plain = len(self.plain.compress(raw))
        saved = [(plain - len(c.compress(raw)), i) for i, c in enumerate(self.given)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def _best(self, block: str, places: list[tuple[int, int]], mine: list[str]) -> tuple[int, int, tuple] | None:
        """First and end word of the notice of the template that saves most among those confirmed, and its row."""
        if not mine:
            return None
        have, match = Counter(mine), SequenceMatcher(None, autojunk=False)
        match.set_seq2(mine)
        for _, i in self._ranked(block[places[0][0] : places[-1][1]]):
            run = self._confirmed(i, have, match)
            if not run:
                continue
            lo, hi = max(0, run[0].b - AROUND), min(len(mine), run[-1].b + run[-1].size + AROUND)
            near, inner = mine[lo:hi], SequenceMatcher(None, autojunk=False)
            inner.set_seq2(near)
            winners: list[tuple[int, int, tuple]] = []
            for saved, j in self._ranked(block[places[lo][0] : places[hi - 1][1]]):
                if saved <= 0 or (winners and saved < winners[0][0] - CLOSE):
                    break
                run = self._confirmed(j, Counter(near), inner)
                if run:
                    winners.append((saved, j, self._row(j, run, block, places[lo:hi], near)))
            if winners:
                first, last, row = min(winners, key=lambda w: (sum(w[2][2][5:7]), -w[0], w[1]))[2]
                return lo + first, lo + last, row
        return None

    def _confirmed(self, i: int, have: Counter, match: SequenceMatcher) -> list:
        """Matches of template i with the words where its wording is found, else none."""
        theirs = self.words[i]
        need = self.least_share * max(len(theirs), 1)
        if sum(min(n, have[w]) for w, n in self.counts[i].items()) < need:
            return []
        match.set_seq1(theirs)
        run = best_run([m for m in match.get_matching_blocks() if m.size])
        agreed = sum(m.size for m in run)
        if agreed < max(need, 1) or agreed < self.least_share * (run[-1].b + run[-1].size - run[0].b):
            return []
        return run if self.needed[i] <= {w for m in run for w in theirs[m.a : m.a + m.size]} else []

    def _row(self, i: int, run: list, block: str, places: list[tuple[int, int]], mine: list[str]) -> tuple[int, int, tuple]:
        theirs, first, last = self.words[i], run[0].b, run[-1].b + run[-1].size
        agreed = sum(m.size for m in run)
        lacking, added = len(theirs) - agreed, last - first - agreed
        raw = " ".join(block[places[first][0] : places[last - 1][1]].split()).encode()
        plain, size = len(self.plain.compress(raw)), len(self.given[i].compress(raw))
        said, a, b = [], 0, first
        for m in run:
            said.append((theirs[a : m.a], mine[b : m.b]))
            a, b = m.a + m.size, m.b + m.size
        said.append((theirs[a:], []))
        difference = "; ".join(f"-[{' '.join(x)}] +[{' '.join(y)}]" for x, y in said if x or y)
        return first, last, (self.templates[i][0], i, plain, size, (plain - size) / max(plain, 1), lacking, added, difference, lacking + added == 0)


def best_run(matches: list) -> list:
    """The run of adjacent matches with the most words less half of the block's words between them."""
    best, best_gain, start, gain = [], 0.0, 0, 0.0
    for k, m in enumerate(matches):
        gap = (m.b - matches[k - 1].b - matches[k - 1].size) / 2 if k else 0.0
        if gain - gap > 0:
            gain += m.size - gap
        else:
            start, gain = k, float(m.size)
        if gain > best_gain:
            best, best_gain = matches[start : k + 1], gain
    return best


def stem_hits(low: bytes) -> list[int]:
    """Places where a stem begins, in order."""
    hits = []
    for stem in STEMS:
        at = low.find(stem)
        while at >= 0:
            hits.append(at)
            at = low.find(stem, at + 1)
    return sorted(hits)


def reach_of(templates: tuple[tuple[str, str], ...]) -> int:
    """Bytes around a stem that hold each template's words up to its next stem or its end,
    twice over for what wrapping, indents and changed words add."""
    most = 0
    for _, text in templates:
        low = text.lower().encode()
        at = [0, *stem_hits(low), len(low)]
        most = max(most, *(b - a for a, b in zip(at[:-1], at[1:], strict=True)))
    return 2 * most + 100


def candidate_blocks(buf: np.ndarray, off: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of the surroundings of stems, as byte places between words; those that touch are joined."""
    hits = np.array(stem_hits(LOWER[buf].tobytes()), np.int64)
    if not len(hits):
        return []
    row = np.searchsorted(off, hits, "right") - 1
    fresh = np.ones(len(hits), bool)
    fresh[1:] = (np.diff(hits) > 2 * reach) | (np.diff(row) > 0)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(hits)) - 1
    edges = np.unique(np.concatenate([np.flatnonzero(WS[buf]), off]))
    out = []
    for a, b in zip(first, last, strict=True):
        lo, hi = max(off[row[a]], hits[a] - reach), min(off[row[a] + 1], hits[b] + reach)
        out.append((int(row[a]), int(edges[np.searchsorted(edges, lo, "right") - 1]), int(edges[np.searchsorted(edges, hi)])))
    return out


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least_share: float = 0.6) -> DataFrame:
    """One row for each notice of a block. ``block_start`` and ``block_end`` count bytes of the text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = reach_of(templates)
        scanner, names = Scanner(templates, least_share), [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for lo, _, buf, off in pieces(batch.column(1)):
                seen, number = -1, 0
                for row, a, b in candidate_blocks(buf, off, reach):
                    number = number + 1 if row == seen else 0
                    seen = row
                    for got in scanner.notices(buf[a:b].tobytes().decode("utf-8", "replace").strip()):
                        rows.append((batch.column(0)[lo + row].as_py(), number, int(a - off[row]), int(b - off[row]), *got))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2 + [pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
