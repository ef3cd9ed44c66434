"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Every window of a document's words is compared, so a notice is found beside other words, within a line, a comment
block or a paragraph. Dice is 2 * common / (a + b), so at a limit t a template of b bigrams can only match windows of
t / (2 - t) * b to (2 - t) / t * b distinct bigrams: a document that shares fewer with a template isn't compared with
it. A window that begins or ends with a bigram the template lacks is no better than the one without it, so the windows
from one shared bigram to another within those bounds are all that need comparing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.license_texts import TEXTS

LIMIT = 0.8
#: The usual notices of licences (public texts), by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    *TEXTS,
]
WORDS = re.compile(r"[a-z0-9]+")


def bigrams(text: str) -> set[tuple[str, str]]:
    """Distinct bigrams of the words [a-z0-9]+ of the text with A-Z lower-cased."""
    ws = WORDS.findall(text.translate(LOWER))
    return set(zip(ws, ws[1:]))


LOWER = {c: c + 32 for c in range(65, 91)}


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, limit: float = LIMIT):
        self.limit = limit
        self.sets = [(name, bigrams(t)) for name, t in templates]
        if any(not s for _, s in self.sets):
            raise ValueError("a template needs two words at least")
        self.by_bigram: dict[tuple[str, str], list[int]] = {}
        for i, (_, s) in enumerate(self.sets):
            for b in s:
                self.by_bigram.setdefault(b, []).append(i)
        sizes = [len(s) for _, s in self.sets]
        self.low, self.high = min(sizes) * limit / (2 - limit), max(sizes) * (2 - limit) / limit
        self.anchors = self.chosen_anchors()

    def chosen_anchors(self) -> frozenset[str]:
        """Words of which every text that matches a template holds one.

        A match misses at most 1 - t / (2 - t) of a template's bigrams, so anchors that touch more of them can't all be missing.
        """
        out: set[str] = set()
        for _, s in sorted(self.sets, key=lambda x: len(x[1])):
            need = int(len(s) * (1 - self.limit / (2 - self.limit)) + 1e-9) + 1
            left = {b for b in s if out.isdisjoint(b)}
            need -= len(s) - len(left)
            while need > 0:
                gain = Counter(w for b in left for w in set(b))
                # Short words are left for last: they are in most texts.
                w = max(sorted(gain), key=lambda w: (len(w) > 4, gain[w]))
                out.add(w)
                need -= gain[w]
                left = {b for b in left if w not in b}
        return frozenset(out)

    def promising(self, unit: str) -> bool:
        return not self.anchors.isdisjoint(WORDS.findall(unit.translate(LOWER)))

    def best(self, unit: str) -> dict[str, float]:
        """The best Dice at or above the limit, by licence."""
        s = bigrams(unit)
        n = len(s)
        if not self.low <= n <= self.high:
            return {}
        common: dict[int, int] = {}
        for b in s:
            for i in self.by_bigram.get(b, ()):
                common[i] = common.get(i, 0) + 1
        out: dict[str, float] = {}
        for i, k in common.items():
            name, t = self.sets[i]
            if self.limit * (len(t) + n) <= 2 * k and 2 * k / (len(t) + n) > out.get(name, 0):
                out[name] = 2 * k / (len(t) + n)
        return out

    def units(self, text: str) -> Iterator[tuple[int, str]]:
        """(line, unit): lines, paragraphs of two lines or more, and the text if it has more than one paragraph."""
        lines = text.split("\n")
        start = None
        paragraphs = 0
        for i, line in enumerate([*lines, ""]):
            if line.strip(" \t\x0b\x0c\r"):
                if i < len(lines):
                    yield i, line
                start = i if start is None else start
            elif start is not None:
                paragraphs += 1
                if i - start > 1:
                    yield start, "\n".join(lines[start:i])
                start = None
        if paragraphs > 1:
            yield 0, text

    def windows(self, template: int, hits: list[int], before: np.ndarray) -> list[tuple[int, int, float]]:
        """(first, last, Dice) of the best window from each of the hits, places of shared bigrams, where it is at or above the limit.

        before has for each bigram's place the last one before it where the same bigram stands, or -1.
        """
        b, out = len(self.sets[template][1]), []
        shared = np.zeros(len(before), bool)
        shared[hits] = True
        most = b * (2 - self.limit) / self.limit
        for at in hits:
            size = int(most) + 1
            while True:
                new = before[at : at + size] < at
                a = new.cumsum()
                if a[-1] > most or at + size >= len(before):
                    break
                size *= 2
            k = (new & shared[at : at + size]).cumsum()
            fits = self.limit * (b + a) <= 2 * k
            if fits.any():
                dice = np.where(fits, 2 * k / (b + a), 0)
                last = int(dice.argmax())
                out.append((at, at + last, float(dice[last])))
        return out

    def __call__(self, text: str | None) -> list[tuple[str, float, int]]:
        """(licence, best Dice, first line where it is found), in order of the licence.

        Where windows overlap, the line is that of the best of them.
        """
        if not text:
            return []
        low = text.translate(LOWER)
        ws = WORDS.findall(low)
        if self.anchors.isdisjoint(ws):
            return []
        grams = list(zip(ws, ws[1:]))
        hits: dict[int, list[int]] = {}
        for p, g in enumerate(grams):
            for i in self.by_bigram.get(g, ()):
                hits.setdefault(i, []).append(p)
        before, found = None, {}
        for i, places in hits.items():
            name, b = self.sets[i]
            least = self.limit * len(b) / (2 - self.limit) - 1e-9
            if len(places) < least or len({grams[p] for p in places}) < least:
                continue
            if before is None:
                seen: dict[tuple[str, str], int] = {}
                before = np.zeros(len(grams), np.int64)
                for p, g in enumerate(grams):
                    before[p] = seen.get(g, -1)
                    seen[g] = p
            if fits := self.windows(i, places, before):
                first, last, top = fits[0]
                for s, e, dice in fits[1:]:
                    if s > last:
                        break
                    last = max(last, e)
                    if dice > top:
                        first, top = s, dice
                old = found.get(name, (0.0, first))
                found[name] = (max(old[0], *(f[2] for f in fits)), min(old[1], first))
        if not found:
            return []
        starts = [m.start() for m in WORDS.finditer(low)]
        return [(name, d, text.count("\n", 0, starts[p])) for name, (d, p) in sorted(found.items())]


@cache
def scanner_of(templates: tuple[tuple[str, str], ...], limit: float) -> Scanner:
    """One a worker."""
    return Scanner(list(templates), limit)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """doc_id, license, dice and line, a row for each licence found in a document.

    A null, empty or short text finds nothing. Repeated rows give repeated results. Extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(tuple(map(tuple, templates)), limit)
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for f in scanner(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "license", "dice", "line"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, license string, dice double, line long")
