"""Licence notices and texts by Dice similarity of word bigrams.

Texts and templates are normalised to lower-case words. A template of m bigrams can reach a Dice coefficient t only with
a passage of between m t/(2-t) and m (2-t)/t bigrams that shares t (m + n)/2 of its n with the template, so templates are
pruned where no stretch of the longest size holds enough. What is left is scored, passages of every length within the
bounds, which finds notices, headers and whole licences inside longer texts.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

THRESHOLD = 0.8

#: Notices by which works are licensed, and short licences in full. Letters in brackets, names and years don't matter.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0.", "This work is marked with CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}

#: The SPDX identifiers of each licence.
SPDX = {
    "MIT": ["MIT"], "ISC": ["ISC"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "Apache-2.0": ["Apache-2.0"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "LGPL": [f"LGPL-{v}{x}" for v in ("2.0", "2.1", "3.0") for x in ("", "-only", "-or-later")],
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "MPL-2.0": ["MPL-2.0"], "CC-BY": ["CC-BY-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC0": ["CC0-1.0"], "Unlicense": ["Unlicense"],
}
for _name, _ids in SPDX.items():
    TEMPLATES[_name] += [f"SPDX-License-Identifier: {i}" for i in _ids]

#: Licences in full, as they are published: the file of each in ``licence_texts``.
TEXTS = {"Apache-2.0": ["Apache-2.0"], "GPL-2.0": ["GPL-2"], "GPL-3.0": ["GPL-3"], "LGPL": ["LGPL-2.1", "LGPL-3"], "MPL-2.0": ["MPL-2.0"], "CC0": ["CC0-1.0"]}
for _name, _files in TEXTS.items():
    TEMPLATES[_name] += [pkgutil.get_data(__package__, f"licence_texts/{f}.txt").decode() for f in _files]

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Templates:
    """Templates as bigram codes over the templates' own words; every other word is the same stranger."""

    def __init__(self, templates: dict[str, list[str]], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        listed = [(name, words(t)) for name, ts in templates.items() for t in ts]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in listed for w in ws), 1)}
        self.n = len(self.ids) + 1
        self.names = [name for name, _ in listed]
        grams = [np.unique(self.grams(self.codes(ws)), return_counts=True) for _, ws in listed]
        self.sizes = np.array([int(n.sum()) for _, n in grams])
        self.known = np.unique(np.concatenate([g for g, _ in grams]))
        self.counts = np.zeros((len(self.known), len(listed)), dtype=np.int32)
        for k, (g, n) in enumerate(grams):
            self.counts[np.searchsorted(self.known, g), k] = n
        self.needs = np.array([threshold * (self.bounds(m)[0] + m) / 2 for m in self.sizes])  # bigrams that a passage shares at least

    def codes(self, ws: list[str]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws))

    def grams(self, codes: np.ndarray) -> np.ndarray:
        return codes[:-1] * self.n + codes[1:]

    def bounds(self, size: int) -> tuple[int, int]:
        """Bigrams of the shortest and longest passage that can reach the threshold with a template of ``size``."""
        t = self.threshold
        return int(np.ceil(size * t / (2 - t) - 1e-9)), int(size * (2 - t) / t + 1e-9)

    def _passages(self, k: int, at: np.ndarray, grams: np.ndarray) -> Iterator[tuple[float, int, int, int]]:
        """(similarity, shared, first bigram, bigrams): for each first bigram the passage most like template k, if it reaches the threshold.

        ``at`` has the places, in order, of bigrams that the template has, ``grams`` their places in ``known``.
        Passages that begin or end with other bigrams are less like it than what they hold.
        """
        size, high, have = int(self.sizes[k]), self.bounds(int(self.sizes[k]))[1], self.counts[grams, k]
        ends = np.searchsorted(at, at + high)
        starts = np.flatnonzero(ends - np.arange(len(at)) >= self.needs[k] - 1e-9)
        if not len(starts):
            return
        # the how-manieth of its kind each bigram is, from the text's beginning
        order = np.argsort(grams, kind="stable")
        firsts = np.concatenate(([True], grams[order][1:] != grams[order][:-1]))
        nth = np.empty(len(at), dtype=np.int64)
        nth[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(firsts, np.arange(len(at)), 0))
        for s in starts.tolist():
            z = ends[s]
            inside = grams[s:z]
            # from this start on: less the bigrams of its kind before it
            kinds, inverse, first = _kinds(inside)
            ok = nth[s:z] - nth[s:z][first][inverse] < have[s:z]
            shared = np.cumsum(ok)
            scores = 2 * shared / (size + at[s:z] - at[s] + 1)
            j = int(scores.argmax())
            if scores[j] >= self.threshold:
                yield float(scores[j]), int(shared[j]), int(at[s]), int(at[s + j] - at[s] + 1)

    def matches(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, similarity, first word, words) of the passages that are like a template, in order.

        Of passages that overlap, the one counts that shares most, weighed by its similarity: so a whole licence goes
        before the notice that it quotes, and a notice before others of much the same words. All others are kept.
        """
        ws = words(text)
        if len(ws) < 2:
            return []
        grams = self.grams(self.codes(ws))
        place = np.searchsorted(self.known, grams).clip(max=len(self.known) - 1)
        hits = np.flatnonzero(self.known[place] == grams)
        if not len(hits):
            return []
        place = place[hits]
        has = self.counts[place] > 0
        found = []
        for k in np.flatnonzero(has.sum(axis=0) >= self.needs - 1e-9).tolist():
            mine = np.flatnonzero(has[:, k])
            found += [(-shared * score, -score, self.names[k], first, n + 1, score) for score, shared, first, n in self._passages(k, hits[mine], place[mine])]
        found.sort()
        taken: list[tuple[int, int]] = []
        kept: list[tuple[str, float, int, int]] = []
        for _, _, name, first, n, score in found:
            i = bisect_left(taken, (first, 0))
            if (i == len(taken) or taken[i][0] >= first + n) and (i == 0 or taken[i - 1][1] <= first):
                insort(taken, (first, first + n))
                kept.append((name, score, first, n))
        return sorted(kept, key=lambda m: m[2])


def _kinds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, for each element its value's place among them, and where each value is met first."""
    kinds, first, inverse = np.unique(x, return_index=True, return_inverse=True)
    return kinds, inverse, first


@lru_cache(maxsize=4)
def _standard(threshold: float) -> Templates:
    return Templates(TEMPLATES, threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, similarity, first_word, n_words): a row for each passage that is like a licence, none for other texts.

    A licence that a text holds in several places has a row for each. Null and empty texts hold none; repeated rows are
    found each; rows without an id too. No rows give no rows. Texts are scanned whole, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold) if templates else _standard(threshold)
        for b in batches:
            rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for m in known.matches(t.as_py())]
            columns = list(zip(*rows)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "similarity", "first_word", "n_words"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, license string, similarity double, first_word int, n_words int")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """One row per passage that is like a licence, with its similarity in millionths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs)
    return found.select("doc_id", "license", F.round(F.col("similarity") * 1_000_000).cast("long").alias("similarity_ppm"), "first_word", "n_words")
