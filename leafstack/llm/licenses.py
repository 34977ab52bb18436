"""License scans by patience alignment.

A stretch of text is aligned with a template by anchors, words that occur once in both.  The longest
increasing subsequence of their places is kept, and the gaps between neighbouring anchors are
aligned likewise, down to gaps without anchors, of which only equal ends count.  A license is found
where the aligned words cover enough of its template.
"""

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_groups, without

# Share of a template's words that a find must cover.
COVERAGE = 0.9
WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")

# License notices in their public wording.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Affero General Public License for more details."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Lesser General Public License for more details."),
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Lesser General Public License for more details."),
    "MIT": "Released under the MIT License.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}

# Telling words: a find has them all, one after the other, with nothing between.
TELLING = {
    "AGPL-3.0-header": ["GNU Affero General Public License", "either version 3 of"],
    "Apache-2.0": ["Apache License Version 2.0"],
    "Apache-2.0-header": ["Apache License Version 2.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-NC-4.0": ["CC BY NC 4.0"],
    "CC-BY-SA-4.0": ["CC BY SA 4.0"],
    "BSD-3-Clause": ["Neither the name of", "endorse or promote"],
    "GPL-2.0-header": ["GNU General Public License", "either version 2 of"],
    "GPL-3.0": ["GNU General Public License version 3"],
    "GPL-3.0-header": ["GNU General Public License", "either version 3 of"],
    "LGPL-2.1-header": ["GNU Lesser General Public License", "either version 2.1 of"],
    "LGPL-3.0-header": ["GNU Lesser General Public License", "either version 3 of"],
    "MIT": ["MIT License"],
    "MPL-2.0-header": ["Mozilla Public License v 2.0"],
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops, piles, before = [], [], []
    for k, v in enumerate(values):
        at = bisect_left(tops, v)
        before.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[at], piles[at] = v, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _once(words, lo: int, hi: int) -> dict:
    """Place of each word that occurs once in words[lo:hi]."""
    at = {}
    for k in range(lo, hi):
        at[words[k]] = -1 if words[k] in at else k
    return {w: k for w, k in at.items() if k >= 0}


def align(text, template) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of the patience alignment, in order."""
    found, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        lo, hi, first, last = gaps.pop()
        while lo < hi and first < last and text[lo] == template[first]:  # equal ends
            found.append((lo, first))
            lo, first = lo + 1, first + 1
        while lo < hi and first < last and text[hi - 1] == template[last - 1]:
            hi, last = hi - 1, last - 1
            found.append((hi, last))
        if lo >= hi or first >= last:
            continue
        here, there = _once(text, lo, hi), _once(template, first, last)
        anchors = sorted((here[w], k) for w, k in there.items() if w in here)
        anchors = [anchors[k] for k in increasing([a[1] for a in anchors])]
        if not anchors:
            continue
        found += anchors
        edges = [(lo - 1, first - 1), *anchors, (hi, last)]
        gaps += [(a[0] + 1, b[0], a[1] + 1, b[1]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(found)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, WORDS.findall(text.lower().encode())
        self.count = {}
        for w in self.words:
            self.count[w] = self.count.get(w, 0) + 1
        self.need = max(1, -(-int(1000 * COVERAGE) * len(self.words) // 1000))  # words to cover

        phrases = [WORDS.findall(p.lower().encode()) for p in TELLING.get(name, ())]
        self.telling = [(k, len(p)) for p in phrases for k in range(len(self.words)) if self.words[k:k + len(p)] == p]
        # words that occur once, by which copies are placed
        self.single = {w: k for k, w in enumerate(self.words) if self.count[w] == 1}

    def tells(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether every telling run of words is aligned with a run of the text."""
        place = {k: at for at, k in pairs}
        return all(k in place and all(place.get(k + i) == place[k] + i for i in range(n)) for k, n in self.telling)

    def finds(self, words: list[bytes], there: set) -> list[tuple[int, int, int]]:
        """(matched, first word, last word + 1) of all non-overlapping finds, best first.

        Windows of twice the template, half a template apart, so that any stretch of its length lies
        whole in one, are aligned if they hold enough of its words.  Where copies follow each other
        such windows hold words twice, so windows of the template's length are aligned too, at every
        place where a quarter of the single words would put a copy.
        """
        size = len(self.words)
        if sum(n for w, n in self.count.items() if w in there) < self.need:
            return []
        hits = [k for k, w in enumerate(words) if w in self.count]
        step = max(1, size // 2)
        tries = {(max(at, 0), 2 * size) for hit in hits for at in (hit // step * step - step, hit // step * step)}
        votes = Counter(hit - self.single[words[hit]] for hit in hits if words[hit] in self.single)
        tries |= {(max(at, 0), size + min(at, 0)) for at, n in votes.items() if 4 * n >= len(self.single)}
        out = set()
        for begin, length in tries:
            window = words[begin:begin + length]
            inside = set(window)
            if sum(n for w, n in self.count.items() if w in inside) < self.need:
                continue
            pairs = align(window, self.words)
            if len(pairs) >= self.need and self.tells(pairs):
                out.add((len(pairs), begin + pairs[0][0], begin + pairs[-1][0] + 1))
        best, begins, ends = [], [], []  # the last two in text order
        for m in sorted(out, key=lambda m: (-m[0], m[2] - m[1], m[1])):
            at = bisect_left(begins, m[1])
            if (at == 0 or ends[at - 1] <= m[1]) and (at == len(begins) or m[2] <= begins[at]):
                best.append(m)
                begins.insert(at, m[1])
                ends.insert(at, m[2])
        return best


def scan_text(data: bytes, templates: list[Template]) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first byte, last byte + 1) in text order; a find within a find of more words is left out."""
    lower = data.lower()
    words = WORDS.findall(lower)
    there = set(words)
    finds = [sorted((a, b, n) for n, a, b in t.finds(words, there)) for t in templates]
    if not any(finds):
        return []

    def within(n, a, b):
        """Whether a find of more words holds words a to b; finds of one template do not overlap."""
        for own in finds:
            at = bisect_right(own, (a, len(words) + 1, 0)) - 1
            if at >= 0 and own[at][1] >= b and own[at][2] > n:
                return True
        return False

    found = [(t, n, a, b) for t, own in zip(templates, finds, strict=True) for a, b, n in own if not within(n, a, b)]
    spans = [m.span() for m in WORDS.finditer(lower)]
    return [(t.name, round(n / len(t.words), 4), n, spans[a][0], spans[b - 1][1]) for t, n, a, b in sorted(found, key=lambda x: (x[2], x[0].name))]


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each license found in each document, and one with nulls for a document without any.

    Columns: those of `docs` but the text, `license`, `coverage` (share of the template's words that
    are aligned, COVERAGE at least), `matched` words, and the find as bytes `first_byte` to
    `end_byte` of the UTF-8 text.  Words are runs of letters and digits, in any case.  The whole
    text is read; null text is empty; a notice that comes twice is found twice; equal rows give
    equal finds; an empty table gives no rows; input columns named like an output are replaced.
    """
    docs = without(docs, "license", "coverage", "matched", "first_byte", "end_byte")
    kept = [c for c in docs.columns if c != text]
    new = [("license", T.StringType()), ("coverage", T.DoubleType()), ("matched", T.IntegerType()), ("first_byte", T.LongType()), ("end_byte", T.LongType())]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new])
    wanted = dict(templates or TEMPLATES)

    def scan(batches):
        ready = [Template(n, t) for n, t in wanted.items()]
        for group, batch in text_groups(batches):
            take, rows = [], []
            for k, data in enumerate(group):
                own = scan_text(data, ready) or [(None,) * 5]
                take += [k] * len(own)
                rows += own
            types = [pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(take)) for c in batch.columns[:-1]] + columns, names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(scan, schema)
