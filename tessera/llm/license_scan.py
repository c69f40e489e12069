"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

A template of q five-word shingles belongs to a window class: class 0 has windows of one shingle (for q < 8,
where one shared shingle is evidence enough to look), class S = 16, 32, 64, ... has windows of S + S / 4
shingles every S / 4, with 0.4 S < q <= 0.8 S, so that a stretch of S shingles - the template with a
quarter of foreign words in it - lies whole in some window.  A window that holds 0.8 of a template's
shingles has a Jaccard similarity of at least 0.32 / 1.33 = 0.24 with it; one of HASHES bands of a
single row then agrees with probability 1 - 0.76^HASHES, 1 - 2e-8 for 64.  A window's values are the
smaller ones of its blocks' values, so each shingle is hashed once for all windows and classes.

A retrieved template is verified on the window by exact containment.  Documents are read once and never shuffled; the templates
are a fixed list (or the caller's, of at most ``MOST_TEMPLATE_BYTES``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, WordHashes, id_type, map_text, mix

HASHES = 64
TINY = 8
SMALLEST_CLASS = 16
MOST_TEMPLATE_BYTES = 4 << 20

#: Notices and openings of public licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Words(WordHashes):
    """Hashes of words without ASCII punctuation at the ends; 0 for a word that is nothing else."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_EDGE)
        if bare == word:
            return super().__missing__(word)
        value = self[bare] if bare else 0
        if len(self) < self.bound:
            self[word] = value
        return value


def positions(text: bytes, table: Words) -> tuple[np.ndarray, np.ndarray]:
    """Five-word shingles in order, and the word each begins at; words that are punctuation only do not count.
    A text of fewer than five words has none."""
    ws = text.lower().split()
    h = np.fromiter(map(table.__getitem__, ws), np.uint64, len(ws))
    at = np.flatnonzero(h)
    h = h[at]
    m = len(h) - 4
    if m < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = h[:m] * _STEP[0]
    for i in range(1, 5):
        s += h[i : m + i] * _STEP[i]
    return mix(s), at


_SEEDS = np.random.default_rng(97).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def block_minima(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(HASHES, blocks) smallest values of each hash in the blocks that begin at ``starts``."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(starts)), np.uint32)
    for k in range(HASHES):
        v = high * np.uint32(_SEEDS[k] >> np.uint64(32) | np.uint64(1))
        v ^= v >> np.uint32(15)
        v *= np.uint32(_SEEDS[k] & np.uint64(0xFFFFFFFF))
        out[k] = np.minimum.reduceat(v, starts)
    return out


class Library:
    """Templates by window class, with their signatures."""

    def __init__(self, templates, percent: int):
        self.percent = percent
        table = Words()
        self.names, self.sets, self.spans = [], [], []
        by_class: dict[int, list[int]] = {}
        for name, text in templates:
            s, _ = positions(text.encode(), table)
            if not len(s):
                continue
            s = np.unique(s)
            k = len(self.names)
            size = 0
            if len(s) >= TINY:
                size = SMALLEST_CLASS
                while 0.8 * size < len(s):
                    size *= 2
            self.names.append(name)
            self.sets.append(s)
            by_class.setdefault(size, []).append(k)
        tiny = by_class.pop(0, [])
        v = np.concatenate([np.empty(0, np.uint64), *[self.sets[k] for k in tiny]])
        of = np.repeat(tiny, [len(self.sets[k]) for k in tiny]).astype(np.int64)
        order = np.argsort(v, kind="stable")
        self.tiny = v[order], of[order]
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(v >> np.uint64(48)).astype(np.int64)] = True
        self.classes = []
        for size, members in sorted(by_class.items()):
            sig = np.stack([block_minima(self.sets[k], np.array([0]))[:, 0] for k in members])  # (templates, HASHES)
            self.classes.append((size, members, sig))

    def found(self, s: np.ndarray, template: int, start: int, stop: int):
        """(n common, first and last place) if the shingles in [start, stop) hold enough of the template."""
        want = self.sets[template]
        window = s[start:stop]
        at = np.minimum(np.searchsorted(want, window), len(want) - 1)
        hit = np.flatnonzero(want[at] == window)
        common = len(np.unique(at[hit]))
        if 100 * common < self.percent * len(want):
            return None
        return common, start + int(hit[0]), start + int(hit[-1])

    def scan(self, sequences: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text the templates in it: n common, first and last shingle of the best window."""
        out: list[dict] = [{} for _ in sequences]
        lengths = np.array([len(s) for s in sequences])
        if not lengths.sum():
            return out

        def keep(d: int, template: int, start: int, stop: int) -> None:
            if (x := self.found(sequences[d], template, start, stop)) and x[0] > out[d].get(template, (0,))[0]:
                out[d][template] = x

        full = np.flatnonzero(lengths)
        flat = np.concatenate(sequences)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(np.arange(len(sequences)), lengths)
        values, of = self.tiny
        if len(values):
            near = np.flatnonzero(self.gate[(flat >> np.uint64(48)).astype(np.int64)])
            lo, hi = np.searchsorted(values, flat[near], "left"), np.searchsorted(values, flat[near], "right")
            for p, a, b in zip(near[hi > lo].tolist(), lo[hi > lo], hi[hi > lo]):
                d = int(owner[p])
                for template in of[a:b].tolist():
                    q, at = len(self.sets[template]), p - int(begins[d])
                    keep(d, template, max(0, at - q - q // 4), at + q + q // 4 + 1)
        base = SMALLEST_CLASS // 4
        if not self.classes:
            return out
        blocks = -(-lengths[full] // base)
        first_block = np.concatenate([[0], np.cumsum(blocks)])
        starts = np.repeat(begins[full], blocks) + (np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)) * base
        minima = block_minima(flat, starts)
        size = SMALLEST_CLASS
        top = max(c[0] for c in self.classes)
        while True:
            for _, members, sig in (c for c in self.classes if c[0] == size):
                # A window is five blocks in a row; blocks past a text's end repeat its last one.
                ends = np.repeat(first_block[1:], blocks) - 1
                i = np.arange(first_block[-1])
                window = minima
                for step in range(1, 5):
                    window = np.minimum(window, minima[:, np.minimum(i + step, ends)])
                for row, template in zip(sig, members):
                    agree = np.flatnonzero((window == row[:, None]).any(axis=0))
                    text = np.searchsorted(first_block, agree, "right") - 1
                    for w, t in zip(agree.tolist(), text.tolist()):
                        d, at = int(full[t]), (w - int(first_block[t])) * (size // 4)
                        keep(d, template, at, at + size + size // 4)
            if size >= top:
                return out
            # Two blocks make one of the next class.
            after = -(-blocks // 2)
            next_first = np.concatenate([[0], np.cumsum(after)])
            left = np.repeat(first_block[:-1], after) + 2 * (np.arange(next_first[-1]) - np.repeat(next_first[:-1], after))
            right = np.minimum(left + 1, np.repeat(first_block[1:], after) - 1)
            minima = np.minimum(minima[:, left], minima[:, right])
            blocks, first_block, size = after, next_first, size * 2


def template_rows(table: DataFrame, license: str = "license", text: str = "text") -> list[tuple[str, str]]:
    """(license, text) of a table of whole licence texts, for ``scan``; null names or texts are left out.  Over MOST_TEMPLATE_BYTES: ValueError."""
    rows = table.select(F.col(f"`{license}`").cast("string").alias("n"), F.col(f"`{text}`").cast("string").alias("t")).filter("n IS NOT NULL AND t IS NOT NULL")
    if (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > MOST_TEMPLATE_BYTES:
        raise ValueError("scan the templates in parts")
    return [(r.n, r.t) for r in rows.orderBy("n", "t").collect()]


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, license, containment, n_common, n_template, start_word, end_word): for each row of ``docs`` and license the
    template that is in it best (of equal ones the first), where percent of the template's five-word shingles or
    more are in one window.  Words are split at [\\x20\\x09-\\x0D], A-Z lower-cased, ASCII punctuation at the ends dropped;
    [start_word, end_word) counts all words of the text.  Null or empty texts, and texts of fewer than five
    words, have no license; a template of fewer than five words is never found.  Repeated rows, and rows of a null id, are scanned
    each; ids are of any type; an empty table gives no rows; other columns are not read.  ``templates``: pairs of name and text, see ``template_rows``.
    """
    if sum(len(t.encode()) for _, t in templates) > MOST_TEMPLATE_BYTES:
        raise ValueError("scan the templates in parts")
    shared = docs.sparkSession.sparkContext.broadcast(Library(templates, percent))
    kind = pa.list_(pa.struct([("license", pa.string()), ("n_common", pa.int64()), ("n_template", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))

    def work(part, texts):
        table, library = Words(), shared.value
        placed = [positions(t, table) for t in texts]
        rows = []
        for (s, at), hits in zip(placed, library.scan([s for s, _ in placed])):
            best: dict[str, dict] = {}
            for k, (common, a, b) in sorted(hits.items()):
                n = len(library.sets[k])
                old = best.get(library.names[k])
                if old is None or common * old["n_template"] > old["n_common"] * n:
                    best[library.names[k]] = {"license": library.names[k], "n_common": common, "n_template": n, "start_word": int(at[a]), "end_word": int(at[b + 4]) + 1}
            rows.append(list(best.values()))
        return {"doc_id": part.column(0), "found": pa.array(rows, kind)}

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = map_text(source, work, f"doc_id {id_type(docs, doc_id)}, found array<struct<license:string,n_common:long,n_template:long,start_word:long,end_word:long>>")
    out = out.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    return out.select(F.col("doc_id").alias(doc_id), "license", (F.col("n_common") / F.col("n_template")).alias("containment"), "n_common", "n_template", "start_word", "end_word")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
