"""Licence texts and notices inside documents, by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower-case ASCII letters, punctuation as
white space.  A match is a span of words whose bigrams have a Dice coefficient of
``THRESHOLD`` or more with a template's: twice the shared bigrams over those of both, a
repeated bigram counted as often as both have it.  A span of a bigrams can reach a
threshold t with a template of b only if t / (2 - t) * b <= a <= (2 - t) / t * b, and only
if it holds at least t / 2 * (a + b) of the template's bigrams.  An index of bigrams counts
what a text holds of each template, and templates under the bound are pruned before any
coefficient, as are starts with too few of them within the longest span.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomplan.llm.common import U64, lowered, portions, shingle_codes, table, word_codes

THRESHOLD = 0.8
MATCHES = "doc_id long, license string, first_word long, n_words long, dice double"
#: Punctuation becomes white space, so that it neither joins nor makes words.
NORMAL = bytes(32 if b < 128 and not chr(b).isalnum() and not chr(b).isspace() else b for b in range(256))

#: The warranty paragraphs that whole licences end with.
AS_IS_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
AS_IS_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

#: Notices, opening paragraphs and whole short licences; ``read_templates`` reads others from files.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause full": f"{BSD_2} {AS_IS_BSD}",
    "BSD-3-Clause full": f"{BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {AS_IS_BSD}",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. ' + AS_IS_MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
TEMPLATES["MIT full"] = f"{TEMPLATES['MIT']} {AS_IS_MIT}"
TEMPLATES["ISC full"] = f"{TEMPLATES['ISC']} {AS_IS_ISC}"


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Licence texts of a folder, each file's name without its suffix as the licence.

    More than 2,000 files, or one of more than 1 MB, are an error.
    """
    files = spark.read.format("binaryFile").load(folder)
    large = files.where("length > 1048576").select("path").first()
    if large:
        raise ValueError(f"{large['path']} is larger than 1 MB")
    files = files.select("path", "content").limit(2_001).collect()
    if len(files) > 2_000:
        raise ValueError("more than 2,000 templates")
    return {r["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]: bytes(r["content"]).decode("utf-8", "replace") for r in files}


def normalised(text: str | None) -> bytes:
    return lowered(text).translate(NORMAL)


def spans(where: np.ndarray, codes: np.ndarray, size: int, threshold: float, times: dict[int, int] | None = None) -> list[tuple[int, int, float]]:
    """Disjoint (first bigram, last bigram, Dice) of spans that reach the threshold, best first, in order of place.

    where, codes: places and codes of a text's bigrams that the template of ``size`` bigrams
    has too; times: how often it has each, once if not said.  The best span starts and
    ends at such a place.  Only the best end of each start is held; where a better span
    takes that end, the start looks again for one before it.  A span of the threshold is
    two thirds as long as the longest or more, so a start looks again a few times at most, and
    the time grows with the text.
    """
    low, high = math.ceil(threshold / (2 - threshold) * size - 1e-9), math.floor((2 - threshold) / threshold * size + 1e-9)
    ends = np.searchsorted(where, where + high, side="left")
    spent = _spent(codes, times)

    def best(i: int, end: int) -> tuple[float, int, int] | None:
        """Best span from ``i`` that ends before ``end``: (minus Dice, first, last), the shortest of equals."""
        length = where[i:end] - where[i] + 1
        dice = np.where(length >= low, 2 * np.cumsum(spent[i:end] < i) / (length + size), 0.0)
        j = int(dice.argmax())
        return (-float(dice[j]), i, i + j) if dice[j] >= threshold else None

    # A span shares low bigrams or more, all within the longest span from its start.
    starts = np.flatnonzero(ends - np.arange(len(where)) >= low)
    heap = [found for i in starts.tolist() if (found := best(i, int(ends[i])))]
    heapq.heapify(heap)
    firsts: list[int] = []
    kept: list[tuple[int, float]] = []
    while heap:
        minus, i, j = heapq.heappop(heap)
        # Kept spans are disjoint and in order: one that holds i starts by it, the next one may cut the end.
        at = bisect.bisect_right(firsts, i)
        if at and kept[at - 1][0] >= i:
            continue
        if at < len(firsts) and firsts[at] <= j:
            if shorter := best(i, firsts[at]):
                heapq.heappush(heap, shorter)
            continue
        firsts.insert(at, i)
        kept.insert(at, (j, -minus))
    return [(int(where[i]), int(where[j]), dice) for i, (j, dice) in zip(firsts, kept)]


def _spent(codes: np.ndarray, times: dict[int, int] | None) -> np.ndarray:
    """For each bigram the index from which on a span has used up the template's equal ones before it, or -1.

    It adds to what a span shares if the span starts after that index.
    """
    own, place = np.unique(codes, return_inverse=True)
    often = np.array([times[c] if times else 1 for c in own.tolist()], dtype=np.int64)[place] if len(own) else np.zeros(0, dtype=np.int64)
    order = np.argsort(place, kind="stable")
    before = np.arange(len(codes)) - often[order]
    same = (before >= 0) & (place[order[np.maximum(before, 0)]] == place[order])
    out = np.full(len(codes), -1, dtype=np.int64)
    out[order[same]] = order[before[same]]
    return out


class Templates:
    """Bigrams of all templates, and for each of them the templates that have it."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names: list[str] = []
        codes_of, times_of = [], []
        for name, text in sorted(texts.items()):
            codes, counts = word_codes([normalised(text)])
            if len(codes) > 1:
                own, n = np.unique(shingle_codes(codes, counts, 2)[0], return_counts=True)
                self.names.append(name)
                codes_of.append(own)
                times_of.append(n)
        self.all, place = np.unique(np.concatenate(codes_of), return_inverse=True) if codes_of else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))
        self.sizes = np.array([int(n.sum()) for n in times_of])
        self.gate = np.zeros(1 << 16, dtype=bool)
        self.gate[self.all >> U64(48)] = True
        of = np.repeat(np.arange(len(codes_of)), [len(c) for c in codes_of])
        #: Place in ``all`` to how often, by template; and the templates of each place, end to end.
        self.times = [dict(zip(place[of == k].tolist(), times_of[k].tolist())) for k in range(len(codes_of))]
        order = np.argsort(place, kind="stable")
        self.templates, self.starts = of[order], np.searchsorted(place[order], np.arange(len(self.all) + 1))

    def likely(self, which: np.ndarray, threshold: float) -> list[int]:
        """Templates of which a text has enough bigrams, at the places ``which`` of ``all``."""
        n = self.starts[which + 1] - self.starts[which]
        at = np.repeat(self.starts[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        held = np.bincount(self.templates[at], minlength=len(self.sizes))
        return np.flatnonzero(held >= threshold / (2 - threshold) * self.sizes - 1e-9).tolist()


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each span of a text that matches a template.

    ``docs``: doc_id, text.  first_word counts the words of the normalised text from
    0.  Spans of one template don't overlap; the better one stays, then the
    earlier.  Where a span matches several templates, there is a row for each.
    Null, empty and one-word texts match nothing; repeated rows give repeated matches,
    and null ids stay null; equal coefficients go to the earlier, shorter span.  Very long
    texts are searched whole, in time that grows with the bigrams they share: repeated
    licences take some seconds a MB.  Extra
    columns are ignored.  A template of fewer than two words never matches.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    names = [c.split()[0] for c in MATCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Templates = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [normalised(t.as_py()) for t in batch.column(1)]
            rows = []
            for a, b in portions(texts):
                codes, counts = word_codes(texts[a:b])
                bigrams, sizes = shingle_codes(codes, counts, 2)
                likely = np.flatnonzero(known.gate[bigrams >> U64(48)])
                place = np.minimum(np.searchsorted(known.all, bigrams[likely]), max(0, len(known.all) - 1))
                hit = known.all[place] == bigrams[likely] if len(known.all) else np.zeros(0, dtype=bool)
                likely, place = likely[hit], place[hit]
                ends = np.cumsum(sizes)
                text = np.searchsorted(ends, likely, side="right")
                found, begins = np.unique(text, return_index=True)
                for i, first_hit, last_hit in zip(found.tolist(), begins.tolist(), [*begins.tolist()[1:], len(text)]):
                    if counts[i] < 2:
                        continue
                    own = slice(first_hit, last_hit)
                    where, which = likely[own] - (ends[i] - sizes[i]), place[own]
                    for k in known.likely(which, threshold):
                        times = known.times[k]
                        mine = np.isin(which, np.fromiter(times, dtype=np.int64))
                        for first, last, dice in spans(where[mine], which[mine], int(known.sizes[k]), threshold, times):
                            rows.append((ids[a + i], known.names[k], first, last - first + 2, dice))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every whole document against every template."""
    return license_matches(table(spark, sf_dir, "documents"))
