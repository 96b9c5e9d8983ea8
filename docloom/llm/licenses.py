"""Licence scans: a trained paragraph classifier confirmed by template comparison.

A paragraph is a non-blank line. Its features are the word 2-grams and 3-grams that also occur in
licence templates (a sparse vector). A multinomial logistic regression over the licence families and
an `unknown` class is trained on the driver from the templates (whole, cut, with words dropped or
put between other text) and on a bounded sample of corpus paragraphs as `unknown`; a temperature
fitted on held-out examples calibrates the probabilities. A predicted family counts only when the
paragraph also compares well with one of its templates (share of the template's 3-grams found, or of
a cut template's span), so the classifier proposes and the template confirms.

Forms too short for 3-grams are found by their sequence of tokens instead, with probability and
similarity 1: a title that is the whole paragraph, an SPDX line (by its first identifier), the phrase
'All rights reserved'. A line of 2 to WRAPPED - 1 tokens (one word alone proves nothing) that the classifier leaves out, next to a
line found in the same document (blank lines aside), belongs to that line's notice if a template of its
family holds the line's sequence.

Training reads at most SAMPLE paragraphs; scanning reads every paragraph of every document.

Defined results: null and empty texts have no paragraphs; a document without licences gives no row;
repeated rows give rows each; ties in probability go to the first family by name; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table, whole

#: Bound of the corpus paragraphs used as `unknown` examples in training.
SAMPLE = 4000
VARIANTS = 60
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
WRAPPED = 8
UNKNOWN = "unknown"
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
FOUND = "doc_id long, paragraph_no int, family string, probability double, similarity double, paragraph string"

#: Short public licence notices by family.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY 4.0.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GNU General Public License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This document is confidential and proprietary. All rights reserved.",
    ],
}


#: Titles that are a paragraph of their own, the phrase found anywhere, and SPDX identifiers by their beginning.
TITLES = {
    "AGPL-3.0": ["GNU Affero General Public License", "GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "Apache-2.0": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Simplified BSD License"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC0": ["CC0", "CC0 1.0", "CC0 1.0 Universal"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3", "GNU GPL v2", "GNU GPL v3"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "MIT": ["MIT License", "MIT License (MIT)", "Expat License"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
}
RESERVED = ("all", "rights", "reserved")
SPDX = "spdx-license-identifier"
SPDX_IDS = [("agpl-3.0", "AGPL-3.0"), ("apache-2.0", "Apache-2.0"), ("bsd-", "BSD"), ("cc-by-nc-", "CC-BY-NC"), ("cc-by-sa-", "CC-BY-SA"), ("cc-by-", "CC-BY"), ("cc0-", "CC0"), ("lgpl-", "LGPL"), ("gpl-", "GPL"), ("mit", "MIT"), ("mpl-2.0", "MPL-2.0")]


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(w: list[str]) -> list[tuple]:
    return [*zip(w, w[1:], strict=False), *zip(w, w[1:], w[2:], strict=False)]


def holds(w: list[str], part: tuple | list[str]) -> bool:
    """Whether the token sequence w holds part."""
    part = list(part)
    return any(x == part[0] and w[i : i + len(part)] == part for i, x in enumerate(w))


BY_TITLE = {start + tuple(tokens(t)): f for f, titles in TITLES.items() for t in titles for start in ((), ("the",))}


def short_form(w: list[str]) -> str | None:
    """The family of a title, an SPDX line or a paragraph with the phrase RESERVED."""
    if found := BY_TITLE.get(tuple(w)):
        return found
    if SPDX in w and (rest := w[w.index(SPDX) + 1 :]):
        return next((f for start, f in SPDX_IDS if rest[0] == start or start.endswith("-") and rest[0].startswith(start) or rest[0].startswith(start + "-")), None)
    return "proprietary" if "reserved" in w and holds(w, RESERVED) else None


class Model:
    """Sparse weights: n-gram -> row; softmax over families (the last is unknown)."""

    def __init__(self, families: list[str], vocabulary: dict[tuple, int], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.families, self.vocabulary, self.weights, self.bias, self.temperature = families, vocabulary, weights, bias, temperature
        self.heads = {g[0] for g in vocabulary}
        self.templates = {f: [(set(zip(w, w[1:], w[2:], strict=False)), w) for w in map(tokens, texts)] for f, texts in TEMPLATES.items()}

    def probabilities(self, grams: set) -> np.ndarray:
        rows = [self.vocabulary[g] for g in grams if g in self.vocabulary]
        z = (self.bias + (self.weights[rows].sum(axis=0) if rows else 0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, family: str, w: list[str]) -> float:
        """The best share of 3-grams in common with a template of the family, by the shorter of both."""
        own, best = set(zip(w, w[1:], w[2:], strict=False)), 0.0
        for grams, _ in self.templates[family]:
            shared = len(own & grams)
            if shared >= 3:
                best = max(best, shared / min(len(grams), max(len(own), 6)))
        return best

    def scan(self, paragraph: str) -> tuple[str, float, float] | None:
        """Family, calibrated probability and template similarity; None where it is unknown or not confirmed."""
        w = tokens(paragraph)
        if found := self.proposed(w):
            return found
        family = short_form(w)
        return (family, 1.0, 1.0) if family else None

    def scan_lines(self, lines: list[str]) -> dict[int, tuple[str, float, float]]:
        """What scan finds, by line number, with the short lines of wrapped notices next to it."""
        found = {i: x for i, line in enumerate(lines) if (x := self.scan(line))}
        if not found:
            return found
        filled = [i for i, line in enumerate(lines) if line.strip()]
        for order in (filled, filled[::-1]):
            for a, b in zip(order, order[1:], strict=False):
                if a in found and b not in found and 1 < len(w := tokens(lines[b])) < WRAPPED and any(holds(t, w) for _, t in self.templates[found[a][0]]):
                    found[b] = (found[a][0], found[a][1], 1.0)
        return dict(sorted(found.items()))

    def proposed(self, w: list[str]) -> tuple[str, float, float] | None:
        """The classifier's family, if a template confirms it."""
        if self.heads.isdisjoint(w):
            return None
        grams = set(ngrams(w))
        if self.vocabulary.keys().isdisjoint(grams):
            return None
        p = self.probabilities(grams)
        k = int(p.argmax())
        family = self.families[k]
        if family == UNKNOWN or p[k] < MIN_PROBABILITY:
            return None
        alike = self.similarity(family, w)
        return (family, round(float(p[k]), 6), round(alike, 6)) if alike >= MIN_SIMILARITY else None


def _examples(background: list[list[str]], rng: random.Random) -> list[tuple[list[str], str]]:
    """Templates, whole and varied, by family; background paragraphs as unknown."""
    out = []
    filler = [w for b in background for w in b] or ["lorem"]
    for family, texts in TEMPLATES.items():
        for text in texts:
            w = tokens(text)
            out.append((w, family))
            for _ in range(VARIANTS):
                v = [x for x in w if rng.random() > 0.06]
                if len(v) > 12 and rng.random() < 0.5:
                    n = rng.randint(len(v) // 2, len(v))
                    start = rng.randint(0, len(v) - n)
                    v = v[start : start + n]
                start = rng.randrange(len(filler))
                extra = filler[start : start + rng.randint(0, 30)]
                v = extra + v if rng.random() < 0.5 else v + extra
                out.append((v, family))
    out += [(b, UNKNOWN) for b in background]
    # single common pairs of template words are no licence
    pairs = [w for texts in TEMPLATES.values() for t in texts for w in [tokens(t)]]
    for _ in range(600):
        w = rng.choice(pairs)
        start = rng.randrange(max(1, len(w) - 2))
        at = rng.randrange(len(filler))
        out.append((filler[at : at + 8] + w[start : start + 2] + filler[at + 8 : at + 16], UNKNOWN))
    return out


def train(background: list[str], seed: int = 7, epochs: int = 200, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Fits on 4 of 5 examples by full-batch gradient descent, calibrates the temperature on the fifth."""
    rng = random.Random(seed)
    known = Model([], {}, np.zeros((0, 0)), np.zeros(0), 1.0)
    plain = [w for w in map(tokens, background) if w and not any(known.similarity(f, w) >= 0.5 for f in TEMPLATES)]
    examples = _examples(plain, rng)
    families = [*sorted(TEMPLATES), UNKNOWN]
    vocabulary: dict[tuple, int] = {}
    for texts in TEMPLATES.values():
        for t in texts:
            for g in ngrams(tokens(t)):
                vocabulary.setdefault(g, len(vocabulary))
    rows, columns = [], []
    for i, (w, _) in enumerate(examples):
        for g in set(ngrams(w)):
            if g in vocabulary:
                rows.append(i)
                columns.append(vocabulary[g])
    rows, columns = np.array(rows), np.array(columns)
    y = np.zeros((len(examples), len(families)))
    y[np.arange(len(examples)), [families.index(f) for _, f in examples]] = 1
    held = np.arange(len(examples)) % 5 == 4
    fit = ~held[rows]
    share = (~held)[:, None] / max(1, (~held).sum())
    weights, bias = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))

    def logits() -> np.ndarray:
        z = np.tile(bias, (len(examples), 1))
        np.add.at(z, rows, weights[columns])
        return z

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    size_w, size_b = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(epochs):
        error = (softmax(logits()) - y) * share
        gradient = np.zeros_like(weights)
        np.add.at(gradient, columns[fit], error[rows[fit]])
        gradient += l2 * weights
        size_w += gradient**2
        size_b += error.sum(axis=0) ** 2
        weights -= rate * gradient / np.sqrt(size_w)
        bias -= rate * error.sum(axis=0) / np.sqrt(size_b)
    z = logits()[held]
    loss = lambda t: -np.log(np.maximum(1e-12, (softmax(z / t) * y[held]).sum(axis=1))).mean()
    return Model(families, vocabulary, weights, bias, float(min((0.25 * 1.1**i for i in range(40)), key=loss)))


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model trained with at most `sample` whole paragraphs of docs.

    They are chosen by a hash of document and paragraph below a bound that follows from their count, so
    about `sample` rows leave the executors whatever the size of docs.
    """
    lines = docs.select("doc_id", F.explode(F.split(whole(F.col("text")), "\n")).alias("p")).where(F.col("p").rlike("[A-Za-z0-9]"))
    share = min(1.0, sample / max(1, lines.count()))
    chosen = lines.select("p", F.xxhash64("doc_id", "p").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return train(sorted(r["p"] for r in chosen.orderBy("h", "p").limit(sample).collect()))


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = model.value.scan_lines
        for batch in batches:
            doc_ids, numbers, families, chances, alikes, paragraphs = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = (text.as_py() or "").split("\n")
                for number, found in scan(lines).items():
                    doc_ids.append(doc_id)
                    numbers.append(number)
                    families.append(found[0])
                    chances.append(found[1])
                    alikes.append(found[2])
                    paragraphs.append(lines[number])
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string()]
            columns = [doc_ids, numbers, families, chances, alikes, paragraphs]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "paragraph_no", "family", "probability", "similarity", "paragraph"])

    return run


def scan_licenses(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph_no, family, probability, similarity, paragraph for every licence paragraph. The model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(shared), FOUND)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, fit_on(docs)).select("doc_id", "paragraph_no", "family", "probability", "similarity")
