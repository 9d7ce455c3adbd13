"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Text is normalised to lower-case words (letters, digits, inner dots), so case, punctuation, line breaks and
comment marks don't count.  A candidate is a run of words, wherever it stands; its bigrams (as multisets) and a
template's give 2 * common / (both sizes).  Since common is at most the smaller size, a candidate can only
reach the threshold t if ``smaller / larger >= t / (2 - t)``.

A template may hold another one nearly whole, as BSD-3-Clause does BSD-2-Clause.  A run of the smaller one inside a run
of the larger one gives way if that has at least half of what the larger template has beyond the smaller one.

Runs: a best run begins and ends with bigrams of the template, as others at its ends only lower the coefficient.
From every such bigram on the run grows until it is too large; beginnings after which too few of the template's
bigrams follow within the largest size can't reach the threshold and are passed over.  Documents are scanned whole.

Defined results: a null or word-less text has no licence; one row comes back for every row given, so
repeated rows repeat; among equal coefficients the smaller licence name wins; extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, table, to_python

THRESHOLD = 0.8
#: Share of a template's bigrams from which another template is taken to hold it.
HELD = 0.95

#: Texts and notices of common public licences, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}

_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
_WORDS = _WORD.findall


def normalized(text: str) -> list[str]:
    return _WORDS(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = []
        self.by_bigram: dict[tuple[str, str], list[int]] = {}
        for name in sorted(templates):
            for text in templates[name]:
                grams = bigrams(normalized(text))
                size = sum(grams.values())
                if size:
                    ratio = threshold / (2 - threshold)
                    for g in grams:
                        self.by_bigram.setdefault(g, []).append(len(self.templates))
                    self.templates.append((name, grams, size, size * ratio, size / ratio))
        self.grams = self.by_bigram.keys()
        #: For each template the smaller ones of other licences that it holds all but whole.
        held = {t: {u for u, (name, own, size, _, _) in enumerate(self.templates) if name != other and size < most and sum((own & grams).values()) >= HELD * size} for t, (other, grams, most, _, _) in enumerate(self.templates)}
        self.holding = {t: us for t, us in held.items() if us}

    def best_run(self, grams, hits, at: int, t: int) -> tuple[float, int, int]:
        """The best coefficient of a run from ``hits[at]`` on with template t, its last bigram, and how many it shares.

        ``hits``: the places in ``grams``, ascending, of bigrams of the template.
        """
        _, own, size, least, most = self.templates[t]
        first = hits[at]
        common = 0
        left = dict(own)
        best = (0.0, first, 0)
        for k in range(at, len(hits)):
            last = hits[k]
            total = last - first + 1
            if total > most:
                break
            g = grams[last]
            if left[g] > 0:
                left[g] -= 1
                common += 1
                if total >= least and 2 * common / (total + size) > best[0]:
                    best = (2 * common / (total + size), last, common)
        return best

    def __call__(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, last line) for each licence found, best run each.

        A run that shares a word with a better one of another licence is that licence's, not its own.
        """
        text = text.lower()
        words = _WORDS(text)
        grams = list(zip(words, words[1:]))
        shared = self.grams & set(grams)
        places: dict[int, list[int]] = defaultdict(list)
        for p, g in enumerate(grams) if shared else ():
            if g in shared:
                for t in self.by_bigram[g]:
                    places[t].append(p)
        runs: set[tuple[float, str, int, int, int, int]] = set()
        for t, hits in places.items():
            name, _, _, least, most = self.templates[t]
            more = math.ceil(least - 1e-9) - 1  # common is at least ``least`` in a run that reaches the threshold
            for at in range(len(hits) - more):
                if hits[at + more] - hits[at] + 1 <= most:
                    score, last, common = self.best_run(grams, hits, at, t)
                    if score >= self.threshold:
                        runs.add((-score, name, hits[at], last, common, t))
        if not runs:
            return []
        starts = [m.start() for m in _WORD.finditer(text)]
        breaks = [i for i, c in enumerate(text) if c == "\n"]
        line = lambda w: bisect_right(breaks, starts[w])
        taken: set[int] = set()
        found: dict[str, tuple[str, float, int, int]] = {}
        holders = [r for r in runs if r[5] in self.holding]
        for score, name, first, last, common, t in sorted(runs):
            if any(t in self.holding[h] and a <= first and last <= z and 2 * (c - common) >= self.templates[h][2] - self.templates[t][2] for _, _, a, z, c, h in holders):
                continue
            here = range(first, last + 2)  # a bigram's second word is the run's too
            if taken.isdisjoint(here):
                taken.update(here)
                found.setdefault(name, (name, -score, line(first), line(last + 1)))
        return list(found.values())


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``found``: an array of (license, dice, first_line, last_line), best first."""
    inner = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))
    names = [f.name for f in inner.value_type]

    def run(batches):
        scanner = Scanner(templates, threshold)
        for b in batches:
            rows = [[dict(zip(names, r)) for r in scanner(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, inner)], names=["doc_id", "found"])

    ddl = "doc_id long, found array<struct<license:string,dice:double,first_line:int,last_line:int>>"
    return to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), ddl)


def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    best = F.get("found", F.lit(0))
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        best["dice"].alias("dice"),
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.transform("found", lambda x: x["license"])), ",").alias("licenses"),
    )
