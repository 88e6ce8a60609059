"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import pathlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ordermin import mixed

_U = np.uint64
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*", re.ASCII)

#: Notices by which texts state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-whole": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-whole": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
        "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor."
    ),
    "Unlicense-whole": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
}


def read_templates(folder: str) -> dict[str, str]:
    """Whole licenses as templates: the text files of a folder, each under its name without the ending."""
    return {p.stem: p.read_text("utf-8", "replace") for p in sorted(pathlib.Path(folder).iterdir()) if p.is_file() and p.suffix in ("", ".txt")}


def words(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits, with points, hyphens and apostrophes inside them."""
    return _WORD.findall(text.lower())


class Scanner:
    """Templates as MinHash signatures in bands of `rows`, for overlapping windows of the templates' lengths.

    Windows of a class of templates begin at every stride (a power of two, at most an eighth of the number n of its longest template's
    shingles) and are n + stride - 1 shingles long, rounded up to whole strides: some window covers any n neighbouring shingles. All windows
    of all texts are hashed, and only templates that a window shares a band with are looked at. A notice holds at least a share `least` of
    its template's distinct shingles. Where a window holds a share `piece` of them (`least` itself for templates of fewer than SHORT
    shingles), its Jaccard similarity has a lower bound, and each class has as many bands as retrieve a window of that
    bound with a probability of at least `sure`.

    So a notice is found if words were put into it or taken out of it in one place, however many (up to `gap` words for those put in), or in
    several places as long as some window keeps that share.

    A retrieved template is verified exactly, word by word, over the whole text: its shingles' places less than `gap` words apart make a notice, which
    begins anew where one of them comes again after `least` was reached.
    """

    #: Templates of so many shingles may be torn in two; shingles that are hashed together, about.
    SHORT, TOGETHER = 24, 1 << 16

    def __init__(self, templates: dict[str, str] | None = None, shingle: int = 5, least: float = 0.8, rows: int = 1, sure: float = 0.9999, piece: float = 0.4, gap: int = 400):
        self.shingle, self.least, self.rows, self.gap = shingle, least, rows, gap
        self.names, self.sets, sizes = [], [], {}
        for name, text in sorted((TEMPLATES if templates is None else templates).items()):
            w = words(text)
            if len(w) < shingle:
                raise ValueError(f"{name} has fewer than {shingle} words")
            self.names.append(name)
            self.sets.append(frozenset(zip(*(w[i:] for i in range(shingle)), strict=False)))
            n = len(w) - shingle + 1  # alike lengths share a class: by eighths of a power of two
            sizes.setdefault((n.bit_length(), (n << 3) >> n.bit_length() if n >= self.SHORT else n), []).append((len(self.names) - 1, n))
        self.classes = []
        for group in sizes.values():
            members, n = [m for m, _ in group], max(n for _, n in group)
            stride = 1 << max(0, (n // 8).bit_length() - 1)
            blocks = -(-(n + stride - 1) // stride)
            share = least if n < self.SHORT else piece
            similarity = 1.0
            for m in members:
                held = max(1, int(np.ceil(share * len(self.sets[m]) - 1e-9)))
                similarity = min(similarity, held / (len(self.sets[m]) + blocks * stride - held))
            self.classes.append([stride, blocks, int(np.ceil(np.log(1 - sure) / np.log1p(-(similarity**rows)))) if similarity < 1 else 1, members])
        self.classes.sort()
        most = max((c[2] for c in self.classes), default=0)
        self.seeds = (mixed(np.arange(1, most * rows + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)).tolist()
        own = [np.array([self._joined([np.array([_hash(x)], dtype=_U) for x in s])[0] for s in sorted(group)], dtype=_U) for group in self.sets]
        for c in self.classes:
            minima = {m: [_order(own[m], s).min(keepdims=True) for s in self.seeds[: c[2] * rows]] for m in c[3]}
            c.append([[(self._joined(minima[m][b * rows : (b + 1) * rows])[0], m) for m in c[3]] for b in range(c[2])])

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> np.ndarray:
        """One hash of several, in order."""
        out = parts[0].astype(_U)
        if len(parts) > 1:
            out = mixed(out)
        for p in parts[1:]:
            out = mixed(out * _U(31) + p)
        return out

    def retrieve(self, hashes: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """(text, template) for each template that shares a band with some window, given the hashes of all shingles of texts behind each
        other and whose they are. A window may reach into the next text; the bound holds whatever else it holds."""
        found, n = set(), len(hashes)
        strides = sorted({c[0] for c in self.classes})
        low: list[dict[int, np.ndarray]] = []
        for k, seed in enumerate(self.seeds):
            level, at = _order(hashes, seed), 1
            low.append({})
            for stride in strides:
                while at < stride:  # minima of twice as many
                    if len(level) % 2:
                        level = np.append(level, level[-1])
                    level, at = np.minimum(level[::2], level[1::2]), at * 2
                low[-1][stride] = level
            if len(low) < self.rows:
                continue
            band = k // self.rows
            for stride, width, bands, _, keys in self.classes:
                if band >= bands:
                    continue
                minima = [_sliding(x[stride], width) for x in low]
                joined = minima[0] if self.rows == 1 else self._joined(minima)
                for key, m in keys[band]:
                    for place in np.flatnonzero(joined == key).tolist():
                        first, last = place * stride, min(n, (place + width) * stride) - 1
                        found.update((t, m) for t in range(int(owner[first]), int(owner[last]) + 1))
            low = []
        return found

    def scan_all(self, texts: list[str]) -> Iterator[list[tuple[str, float, int, int]]]:
        """scan of each text, in order."""
        held: list[list[str]] = []
        size = 0
        for t in texts:
            held.append(words(t) if t else [])
            size += len(held[-1])
            if size >= self.TOGETHER:
                yield from self._scan(held)
                held, size = [], 0
        yield from self._scan(held)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, word after the last) of each match, in order of the text."""
        return next(self._scan([words(text)]))

    def _scan(self, texts: list[list[str]]) -> Iterator[list[tuple[str, float, int, int]]]:
        k = self.shingle
        count = np.array([len(w) for w in texts], dtype=np.int64)
        single = np.fromiter((_hash(x) for w in texts for x in w), dtype=_U, count=int(count.sum()))
        n = np.maximum(0, count - k + 1)
        got: dict[int, list[int]] = {}
        if n.sum() and self.classes:
            whole = self._joined([single[r : len(single) - k + 1 + r] for r in range(k)])
            owner = np.repeat(np.arange(len(texts)), n)
            at = np.arange(len(owner)) + np.repeat(np.cumsum(count) - count - (np.cumsum(n) - n), n)
            for t, m in sorted(self.retrieve(whole[at], owner)):
                got.setdefault(t, []).append(m)
        for t, w in enumerate(texts):
            yield self._verified(w, got[t]) if t in got else []

    def _verified(self, w: list[str], templates: list[int]) -> list[tuple[str, float, int, int]]:
        k, out = self.shingle, []
        places: dict[tuple, list[int]] = {}
        wanted = frozenset().union(*(self.sets[m] for m in templates))
        for i, s in enumerate(zip(*(w[i:] for i in range(k)), strict=False)):
            if s in wanted:
                places.setdefault(s, []).append(i)
        for m in templates:
            own = self.sets[m]
            notice: dict[tuple, int] = {}
            begin = last = -1
            for i, s in [*sorted((i, s) for s in own for i in places.get(s, ())), (len(w) + self.gap, None)]:
                full = len(notice) >= self.least * len(own)
                if notice and (i - last >= self.gap or (full and s in notice)):
                    if full:
                        out.append((self.names[m], len(notice) / len(own), begin, last + k))
                    notice = {}
                if not notice:
                    begin = i
                notice[s] = last = i
        return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _order(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Where each shingle stands in the order of one seed."""
    return ((hashes * _U(seed)) >> _U(32)).astype(np.uint32)


def _sliding(low: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, and of fewer at the end."""
    out, have = low, 1
    while have < width:
        more = min(have, width - have)
        if more >= len(out):
            return out.min(keepdims=True)
        out = np.minimum(out[:-more], out[more:])
        have += more
    return out


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each license notice in each row's whole text: doc_id, license, containment (of the template's five-word
    shingles in the text; 0.8 at least), start_word and end_word long (exclusive; words of licenses.words).

    Null and empty texts have no match. A template's notices follow each other without overlap; templates that share text
    may each match there. Repeated rows match twice; other columns, whatever their names, are left out. Texts of any length are scanned whole. One pass, no shuffle; the templates are a list of fixed size.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    kind = next(f.dataType for f in docs.schema.fields if f.name == doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in batches:
            ids = batch.column(0)
            rows = [(i, *m) for i, found in enumerate(scanner.scan_all(batch.column(1).to_pylist())) for m in found]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["doc_id", "license", "containment", "start_word", "end_word"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, license string, containment double, start_word long, end_word long")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return scan_licenses(table(spark, sf_dir, "documents"))
