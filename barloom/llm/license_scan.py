"""License scans by patience alignment of a text's words with license templates.

A template is looked for in windows of the text that hold enough of its words. In a window, words that
occur once on either side pair up; the longest increasing run of pairs anchors the alignment; before,
between and after the anchors the same is done again, and where a gap has no such word, equal words at
its two ends are matched and then the longest common subsequence. Coverage is the share of the
template's words that are matched.

A template counts as found at ``least`` coverage if all its telling words are matched: names of licenses
and of their clauses, and version numbers. Between the telling words of a template of up to ``SHORT`` words the
text may hold no other one, nor right beside them where the template goes on, so that "CC BY-ND 4.0" is no CC BY and "Lesser General Public License"
no GPL. A license whose match lies inside a longer match of another one is left out (the two clauses of
BSD-2-Clause inside BSD-3-Clause).

Three sound tests come first and lose nothing: the text must hold the telling words and enough of the
template's distinct words, and a window enough words of the template. A window spans ``stretch`` times
the template's length.

Cases: a null or wordless text has no license; of equal coverage the longer template wins, then the first in order, and
of equal windows the first; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, each_text

#: Public license notices in their usual words, by license and form.
NOTICES = {
    "0BSD/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.",
    "Apache-1.1/line": "Licensed under the Apache License, Version 1.1.",
    "Apache-2.0/head": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD/line": "Released under the BSD License.",
    "BSD-2-Clause/line": "Released under the 2-Clause BSD License.",
    "BSD-2-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause/line": "Released under the 3-Clause BSD License.",
    "BSD-3-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0/line": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0/line": "Released under CC0 1.0 Universal.",
    "EPL-1.0/line": "This program is made available under the terms of the Eclipse Public License 1.0.",
    "EPL-2.0/line": "This program is made available under the terms of the Eclipse Public License 2.0.",
    "EUPL-1.2/line": "Licensed under the European Union Public Licence, version 1.2.",
    "ISC/line": "Released under the ISC License.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT/line": "Released under the MIT License.",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-1.1/notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib/text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}
#: GNU licenses: id, what stands before General, versions.
GNU = (("GPL", "", ("1", "2", "3")), ("LGPL", "Library", ("2",)), ("LGPL", "Lesser", ("2.1", "3")), ("AGPL", "Affero", ("3",)))
CLAUSES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def templates() -> dict[str, str]:
    """Notices, the lines of GNU and Creative Commons licenses in their versions, and SPDX lines of them all."""
    out = dict(NOTICES)
    for family, kind, versions in GNU:
        name = " ".join(f"GNU {kind} General Public License".split())
        for v in versions:
            key = f"{family}-{v if '.' in v else v + '.0'}"
            out[f"{key}/line"] = f"This work is licensed under the {name}, version {v}."
            out[f"{key}/notice"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
            out[f"{key}/head"] = f"{name} Version {v} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    for code, words in CLAUSES.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{code}-{v}/line"] = f"Licensed under CC {code} {v}."
            out[f"CC-{code}-{v}/long"] = f"This work is licensed under a Creative Commons {words} {v} International License."
    for name in sorted({k.partition("/")[0] for k in out} - {"BSD"}):
        out[f"{name}/spdx"] = f"SPDX-License-Identifier: {name}"
    return out


TEMPLATES = templates()
SHORT = 40
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Words that tell licenses apart; clauses of Creative Commons count in its templates alone, as do the others' in SPDX lines.
NAMES = frozenset("0bsd affero agpl apache artistic boost bsd bsl cc cc0 commons eclipse epl eupl european gnu gpl isc lesser lgpl library mit mozilla mpl noderivatives noncommercial sharealike unlicense zlib".split())
CODES = frozenset("attribution by nc nd sa".split())
VERSION = re.compile(r"v?\d(?:\.\d+)*")


def telling(words: list[str], codes: bool) -> list[bool]:
    return [w in NAMES or (codes and w in CODES) or bool(VERSION.fullmatch(w)) for w in words]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that ascends on both sides, by patience piles; pairs ascend on the left."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        back.append(piles[p - 1] if p else -1)
        tops[p : p + 1] = [y]
        piles[p : p + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, as the longest increasing run over all matches."""
    at: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        at.setdefault(b[j], []).append(j)
    return increasing([(i, j) for i, w in enumerate(a) for j in at.get(w, ())])


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of template words a and text words b, ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        here, there = Counter(a[i:ie]), Counter(b[j:je])
        place = {w: k for k, w in enumerate(b[j:je], j) if there[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(a[i:ie], i) if here[w] == 1 and w in place])
        if not anchors:
            out += [(i + x, j + y) for x, y in common(a[i:ie], b[j:je])]
            continue
        out += anchors
        x, y = i, j
        for k, m in [*anchors, (ie, je)]:
            todo.append((x, k, y, m))
            x, y = k + 1, m + 1
    return sorted(out)


@dataclass(frozen=True)
class Template:
    license: str
    words: list[str]
    vocabulary: frozenset[str]
    told: list[bool]
    must: frozenset[str]
    codes: bool

    @classmethod
    def of(cls, name: str, text: str) -> Template:
        words = tokens(text)
        codes = not {"cc", "commons"}.isdisjoint(words)
        told = telling(words, codes)
        return cls(name.partition("/")[0], words, frozenset(words), told, frozenset(w for w, t in zip(words, told, strict=True) if t), codes)

    def beside(self, words: list[str], low: int, high: int) -> bool:
        """Another telling word stands next to the telling words at low to high, where the template goes on."""
        places = [k for k, t in enumerate(self.told) if t]
        next_to = [*([high + 1] if places[-1] < len(self.words) - 1 else []), *([low - 1] if places[0] else [])]
        return any(telling([words[k] for k in next_to if 0 <= k < len(words)], self.codes))

    def kept(self, found: list[tuple[int, int]], words: list[str], start: int, stop: int) -> list[tuple[int, int]]:
        """The match in words[start:stop], less what lies beyond another telling word; empty if one is inside or a telling word is missing."""
        if sum(self.told) > sum(self.told[i] for i, _ in found):
            return []
        if len(self.words) > SHORT or not self.must:
            return found
        mine = {start + j for i, j in found if self.told[i]}
        others = [j for j, t in enumerate(telling(words[start:stop], self.codes), start) if t and j not in mine]
        low, high = min(mine), max(mine)
        if any(low < j < high for j in others) or self.beside(words, low, high):
            return []
        first, last = max((j for j in others if j < low), default=-1), min((j for j in others if j > high), default=len(words))
        return [x for x in found if first < start + x[1] < last]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float, stretch: float):
        self.least, self.stretch = least, stretch
        self.templates = [t for name, text in templates.items() if (t := Template.of(name, text)).words]

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first, last word) of each license found, best first."""
        words = tokens(text)
        distinct, out = frozenset(words), []
        for order, t in enumerate(self.templates):
            n = len(t.words)
            need = math.ceil(self.least * n - 1e-9)
            if not t.must <= distinct or len(t.vocabulary & distinct) < len(t.vocabulary) - (n - need):
                continue
            best = self._best(t, words, need)
            if best:
                out.append((-best[0] / n, -n, order, (t.license, best[0] / n, *best)))
        ranked = [x[-1] for x in sorted(out)]
        inside = lambda x, y: y[0] != x[0] and y[3] <= x[3] and x[4] <= y[4] and y[2] > x[2]
        seen: set[str] = set()
        return [x for x in ranked if not any(inside(x, y) for y in ranked) and not (x[0] in seen or seen.add(x[0]))]

    def _best(self, t: Template, words: list[str], need: int) -> tuple[int, int, int] | None:
        """The most words matched in a window, and where."""
        hits = [k for k, w in enumerate(words) if w in t.vocabulary]
        span = max(len(t.words) + 2, math.ceil(self.stretch * len(t.words)))
        best: tuple[int, int, int] | None = None
        reach, stop = -1, 0
        for x, start in enumerate(hits):
            stop = max(stop, x)
            while stop < len(hits) and hits[stop] < start + span:
                stop += 1
            if stop - x < need or hits[stop - 1] <= reach:  # too few, or all inside the window before
                continue
            window = words[start : hits[stop - 1] + 1]
            if not t.must <= set(window):
                continue
            found = patience(t.words, window)
            if len(found) < need or len(found := t.kept(found, words, start, start + len(window))) < need:
                continue
            reach = hits[stop - 1]
            if best is None or len(found) > best[0]:
                best = len(found), start + found[0][1], start + found[-1][1]
        return best


def _batches(batches: Iterator[pa.RecordBatch], templates: dict[str, str], least: float, stretch: float) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, least, stretch)
    for b in batches:
        got = [scanner.scan(t) for t in each_text(b)]
        best = [g[0] if g else (None,) * 5 for g in got]
        columns = list(zip(*best, strict=True)) if best else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array([[x[0] for x in g] for g in got], pa.list_(pa.string())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[2:])],
            names=["id", "found", "license", "coverage", "matched", "first_word", "last_word"],
        )


def scan_licenses(docs: DataFrame, chosen: dict[str, str] | None = None, least: float = 0.8, stretch: float = 1.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, found (all licenses), and the best one's name, coverage and word span."""
    chosen = chosen or TEMPLATES
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, found array<string>, license string, coverage double, matched long, first_word long, last_word long"
    return map_batches(rows, lambda it: _batches(it, chosen, least, stretch), schema)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.size("found").cast("long").alias("n_found"), "license", F.round("coverage", 6).alias("coverage"), "matched", "first_word", "last_word")
