"""Operator 3, licence scans by patience alignment: anchor on words unique to text and template, keep the longest increasing run of anchors, align the gaps again."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhouse.llm.common import blocks

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

#: Public licence notices, by SPDX identifier and form.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-title": "MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words of a template that name the licence or its version, each of which must be among the words that align with it.
NAMED: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("gnu", "affero", "3"),
    "AGPL-3.0-header": ("gnu", "affero", "3"),
    "Apache-2.0": ("apache", "2.0"),
    "Apache-2.0-header": ("apache", "2.0"),
    "BSD-3-Clause": ("neither", "endorse"),
    "CC-BY-4.0": ("creative", "attribution", "4.0"),
    "CC-BY-4.0-short": ("cc", "by", "4.0"),
    "CC-BY-NC-4.0": ("cc", "by-nc", "4.0"),
    "CC-BY-SA-4.0": ("creative", "attribution-sharealike", "4.0"),
    "CC-BY-SA-4.0-short": ("cc", "by-sa", "4.0"),
    "CC0-1.0": ("waived",),
    "EPL-2.0": ("eclipse", "2.0"),
    "GPL-2.0": ("gnu", "2"),
    "GPL-2.0-header": ("gnu", "2"),
    "GPL-3.0": ("gnu", "3"),
    "GPL-3.0-header": ("gnu", "3"),
    "LGPL-2.1-header": ("gnu", "lesser", "2.1"),
    "LGPL-3.0": ("gnu", "lesser", "3"),
    "MIT": ("mit",),
    "MIT-title": ("mit", "license"),
    "MPL-2.0": ("mozilla", "2.0"),
    "Unlicense": ("unencumbered",),
}
#: Words between the first and the last aligned one that make it another licence, unless the template has them itself.
OTHERS = ("lesser", "library", "affero", "noncommercial", "noderivatives")
#: Words of a title, at most; one that stands inside a longer notice is no find of its own.
TITLE = 3
#: A licence tag in a file, which needs no alignment.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases on both sides; pairs come in order of their first number."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str], lo: int = 0, hi: int | None = None, first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """Matched word places ``(text, template)``, increasing on both sides.

    Equal words at both ends of a range match; in what is left, words that occur once on either side are anchors, of
    which the longest increasing run stays; the gaps between anchors are aligned in the same way. A gap without such
    words has no further match.
    """
    out: list[tuple[int, int]] = []
    todo = [(lo, len(text) if hi is None else hi, first, len(template) if last is None else last)]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        places = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = _increasing(sorted((places[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in places))
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        out += anchors
        if anchors:
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, named: dict[str, tuple[str, ...]] = NAMED) -> None:
        self.coverage, self.named = coverage, {k: set(v) for k, v in named.items()}
        self.templates = {k: words_of(v) for k, v in sorted(templates.items())}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        self.vocabulary = {w for v in self.templates.values() for w in v}

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """``(licence, coverage, first word, last word)`` of every template found, best first.

        A template can only reach the coverage where enough of its words stand in a stretch of twice its length, so only
        such stretches, overlapping by half, are aligned; the best one of each template counts. The words that name the
        licence must align, and none of ``OTHERS`` may stand between. A tag is found by its name, at its own word.
        """
        low = text.lower()
        tags = [(m.group(1), 1.0, k, k) for m in TAG.finditer(text) for k in [len(_WORD.findall(low[: m.start(1)]))]] if "spdx" in low else []
        words = _WORD.findall(low)
        known = [(i, w) for i, w in enumerate(words) if w in self.vocabulary]
        if not known:
            return tags
        seen = Counter(w for _, w in known)
        out = []
        for name, template in self.templates.items():
            n, counts = len(template), self.counts[name]
            need = self.coverage * n
            if sum(min(c, seen[w]) for w, c in counts.items()) < need:
                continue
            best: tuple[float, int, int] | None = None
            mine = [i for i, w in known if w in counts]
            starts = sorted({max(0, i // n * n - n) for i in mine} | {i // n * n for i in mine})
            for at in starts:
                stop = min(len(words), at + 2 * n)
                k = bisect_left(mine, at)
                if bisect_left(mine, stop) - k < need:
                    continue
                match = align(words, template, at, stop)
                got = len(match) / n
                if got < self.coverage or (best is not None and got <= best[0]):
                    continue
                aligned = {words[i] for i, _ in match}
                if self.named.get(name, set()) <= aligned and not any(w in words[match[0][0] : match[-1][0]] for w in OTHERS if w not in counts):
                    best = (got, match[0][0], match[-1][0])
            if best:
                out.append((name, *best))
        names = [x for x in out if x[3] - x[2] < TITLE and any(y is not x and y[2] <= x[2] and x[3] <= y[3] for y in out)]
        return tags + sorted((x for x in out if x not in names), key=lambda x: (-x[1], -len(self.templates[x[0]]), x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """``(doc_id, license, coverage, first_word, last_word, found)`` for every row.

    ``found`` lists tags as they stand in the text, then every template of which at least ``coverage`` of the words, those
    that name the licence among them, align with the text, the best first: highest coverage, then longest template, then
    name. The words of a caller's own ``templates`` need no names. The other columns repeat the first and are null without one.
    Words are runs of letters and digits in lower case. Whole texts are scanned where they are read, nothing is
    shuffled. A null or empty text has none; null ids and repeats are rows like others; other columns,
    whatever their names, are dropped. A text of any length is scanned to its end; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, coverage)
        for part, *_ in blocks(batches):
            found = [[{"license": a, "coverage": b, "first_word": c, "last_word": d} for a, b, c, d in scanner.find(t)] for t in part.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "found"])

    got = rows.mapInArrow(run, "doc_id long, found array<struct<license:string,coverage:double,first_word:int,last_word:int>>")
    best = F.get("found", F.lit(0))
    return got.select("doc_id", *[best[c].alias(c) for c in ("license", "coverage", "first_word", "last_word")], "found")
