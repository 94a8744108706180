"""Licence paragraphs by a trained word n-gram classifier, confirmed against templates.

A paragraph is a line of a text. Its features are the words and word pairs that occur in any licence training text, as
counts over the root of the number of all its words and pairs, so long prose drowns them. A softmax regression with one
class for each licence family and one for everything else is fitted on the templates, on short ways to name each family,
on versions of both with words dropped and prose added, and on ``SAMPLE_DOCS`` documents' other lines; a temperature is
then fitted on rows held out, so that the probabilities, that of "unknown" among them, are calibrated. A prediction counts
if its probability reaches ``CONFIDENT`` and ``SIMILAR`` of the smaller side's words and pairs agree with one of the family's texts.

The sample bounds what the classifier is fitted on, and nothing else: every line of every document is classified.

Defined results: null and empty texts have no paragraphs; ties go to the family that comes first; very long texts are read
whole; repeated rows are judged alike; an empty table is fitted without prose and gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm import segments as S

SAMPLE_DOCS, SAMPLE_LINES = 300, 3000
CONFIDENT, SIMILAR, LEAST = 0.5, 0.75, 4  # LEAST: words and pairs that must agree in any case
RESULT = "struct<n_paragraphs:bigint,n_licences:bigint,families:string,spans:string,probability:double>"

# The families with the names they go by, and what their notices say.
NAMES = {
    "MIT": ("MIT", "MIT License", "MIT Licence", "Expat License"),
    "Apache-2.0": ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD": ("BSD-3-Clause", "BSD-2-Clause", "BSD License", "3-Clause BSD License", "2-Clause BSD License", "New BSD License"),
    "GPL": ("GPL-3.0", "GPL-2.0", "GPLv3", "GNU General Public License", "GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL"),
    "LGPL": ("LGPL-3.0", "LGPL-2.1", "GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "GNU LGPL"),
    "AGPL": ("AGPL-3.0", "GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License", "Mozilla Public License, version 2.0"),
    "ISC": ("ISC", "ISC License"),
    "CC-BY": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0": ("CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 Universal Public Domain Dedication"),
}
NAMING = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.",
    "This work is licensed under the {}.", "This work is licensed under a {}.", "SPDX-License-Identifier: {}", "This project is licensed under the terms of the {}.",
    "This software is available under the {}.", "See LICENSE for the full text of the {}.", "License: {}", "This file is part of a program under the {}.",
)
NOTICES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}
CUE = re.compile(r"licen[sc]e|copyright|permission|warrant|redistribut|public domain|creative commons|spdx|\bcc\b", re.IGNORECASE)

FAMILIES = tuple(NAMES)
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_GAP[128:] = False
_BITS = 20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and pairs within lines, the line of each, and the lines' starts and ends."""
    words, begins, _, _ = S.runs(data, offsets, _GAP, lower=True)
    _, starts, ends, _ = S.runs(data, offsets, S.NEWLINE)
    line = np.searchsorted(starts, begins, "right") - 1
    same = line[1:] == line[:-1]
    pairs = S.mix(words[:-1] * np.uint64(S.BASE) + words[1:])[same] if len(words) else words
    return np.concatenate([words, pairs]), np.concatenate([line, line[:-1][same] if len(words) else line]), starts, ends


def _line_grams(texts: list[str]) -> list[np.ndarray]:
    data, offsets = S.column_bytes(pa.array([t.replace("\n", " ") for t in texts], pa.string()))
    grams, line, starts, _ = _grams(data, offsets)
    owner = (np.searchsorted(offsets, starts, "right") - 1)[line]
    order = np.argsort(owner, kind="stable")
    return np.split(grams[order], np.searchsorted(owner[order], np.arange(1, len(texts))))


class Classifier:
    """A fitted softmax regression over n-gram hashes, with the texts that confirm it."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray, known: list[list[np.ndarray]]) -> None:
        self.vocabulary, self.weights, self.bias, self.known = vocabulary, weights, bias, known
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[vocabulary & np.uint64((1 << _BITS) - 1)] = True

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are features, and which ones."""
        some = np.flatnonzero(self.maybe[grams & np.uint64((1 << _BITS) - 1)])
        at = np.minimum(np.searchsorted(self.vocabulary, grams[some]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == grams[some]
        return some[hit], at[hit]

    def chances(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The probability of each class for each of ``n`` owners; the last class is unknown."""
        size = np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
        where, feature = self.places(grams)
        mine = owner[where]
        scores = np.stack([np.bincount(mine, self.weights[feature, c], n) for c in range(len(self.bias))], axis=1) / size[:, None] + self.bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def similar(self, family: int, grams: np.ndarray) -> bool:
        own = np.unique(grams)
        for text in self.known[family]:
            if len(np.intersect1d(own, text, assume_unique=True)) >= max(SIMILAR * min(len(own), len(text)), LEAST):
                return True
        return False


def _versions(text: str, prose: list[str], rng: np.random.Generator) -> list[str]:
    words = text.split()
    out = [text]
    for _ in range(4):
        out.append(" ".join(w for w in words if rng.random() > 0.1))
    for _ in range(6 if len(words) > 16 else 0):
        size = int(rng.integers(8, len(words)))
        at = int(rng.integers(0, len(words) - size + 1))
        out.append(" ".join(words[at: at + size]))
    for _ in range(4 if prose else 0):
        extra = prose[rng.integers(len(prose))].split()[: max(2, len(words) // 2)]
        out.append(" ".join([*extra, *words] if rng.random() < 0.5 else [*words, *extra]))
    return [x for x in out if x]


def fit(prose: list[str], seed: int = 7, steps: int = 250) -> Classifier:
    """Fit on the licence texts and on ``prose`` (lines that are no licences), and set the temperature on every fifth row."""
    rng = np.random.default_rng(seed)
    texts = [[*(x for x in NOTICES.get(f, ())), *(p.format(n) for n in NAMES[f] for p in NAMING)] for f in FAMILIES]
    rows = [(v, k) for k, own in enumerate(texts) for t in own for v in _versions(t, prose, rng)]
    rows += [(t, len(FAMILIES)) for t in prose] + [("", len(FAMILIES))]
    grams = _line_grams([t for t, _ in rows])
    label = np.array([k for _, k in rows])
    vocabulary = np.unique(np.concatenate(_line_grams([t for own in texts for t in own])))
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, g in enumerate(grams):
        at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
        np.add.at(x[i], at[vocabulary[at] == g], 1)
        x[i] /= np.sqrt(max(len(g), 1))
    classes = len(FAMILIES) + 1
    held = np.arange(len(rows)) % 5 == 0
    share = 1 / np.bincount(label[~held], minlength=classes).clip(1)[label[~held]]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((len(vocabulary), classes), np.float32), np.zeros(classes, np.float32)
    moments = [np.zeros_like(z) for z in (w, b, w, b)]
    want = np.eye(classes, dtype=np.float32)[label[~held]]
    train = x[~held]
    for step in range(1, steps + 1):
        z = train @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - want) * share
        for k, (value, slope) in enumerate(((w, train.T @ p + 1e-6 * w), (b, p.sum(axis=0)))):
            moments[k] *= 0.9
            moments[k] += 0.1 * slope
            moments[k + 2] *= 0.99
            moments[k + 2] += 0.01 * slope**2
            value -= 0.1 * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
    z = x[held] @ w + b

    def loss(heat: float) -> float:
        y = z / heat
        return float((np.log(np.exp(y - y.max(axis=1, keepdims=True)).sum(axis=1)) + y.max(axis=1) - y[np.arange(len(y)), label[held]]).mean())

    heat = min(np.geomspace(0.25, 8, 31), key=loss)
    known = [[np.unique(g) for g in _line_grams(own)] for own in texts]
    return Classifier(vocabulary, (w / heat).astype(np.float64), (b / heat).astype(np.float64), known)


def prose_sample(docs: DataFrame) -> list[str]:
    """At most ``SAMPLE_LINES`` lines without a licence cue, of the ``SAMPLE_DOCS`` documents that come first by a hash."""
    texts = docs.where("text IS NOT NULL").orderBy(F.xxhash64("doc_id", "text")).select("text").limit(SAMPLE_DOCS).collect()
    lines = [line.strip() for (text,) in texts for line in text.split("\n")]
    return [x for x in dict.fromkeys(lines) if x and not CUE.search(x)][:SAMPLE_LINES]


def _found(model: Classifier, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """Of each document: its number of paragraphs, and the confirmed ones (byte start, byte end, family, probability)."""
    grams, line, starts, ends = _grams(data, offsets)
    worded = np.bincount(line, minlength=len(starts)) > 0
    chances = model.chances(grams, line, len(starts))
    best = chances.argmax(axis=1)
    likely = np.flatnonzero((best < len(FAMILIES)) & (chances[np.arange(len(best)), best] >= CONFIDENT) & worded) if len(starts) else np.zeros(0, np.int64)
    order = np.argsort(line, kind="stable")
    edges = np.searchsorted(line[order], np.arange(len(starts) + 1))
    bounds = np.searchsorted(starts, offsets)
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    for k in likely.tolist():
        if model.similar(int(best[k]), grams[order[edges[k]: edges[k + 1]]]):
            d = int(np.searchsorted(bounds, k, "right")) - 1
            found.setdefault(d, []).append((int(starts[k] - offsets[d]), int(ends[k] - offsets[d]), int(best[k]), float(chances[k, best[k]])))
    for d in range(len(offsets) - 1):
        yield int(worded[bounds[d]: bounds[d + 1]].sum()), found.get(d, [])


def scan(text: Column, model: Classifier, docs: DataFrame) -> Column:
    """Paragraphs, licence paragraphs, families, spans (family:start:end in code points) and the highest probability."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        data, offsets = S.column_bytes(column)
        rows = []
        for i, j in S.slices(offsets):
            for d, (n, spans) in enumerate(_found(held.value, data, offsets[i: j + 1]), i):
                lead = np.zeros(0, np.int64)
                if spans:
                    lead = np.append(0, np.cumsum((data[offsets[d]: offsets[d + 1]] & 0xC0) != 0x80))
                rows.append({
                    "n_paragraphs": n, "n_licences": len(spans), "families": ",".join(sorted({FAMILIES[k] for _, _, k, _ in spans})),
                    "spans": ",".join(f"{FAMILIES[k]}:{lead[s]}:{lead[e]}" for s, e, k, _ in spans), "probability": max((p for *_, p in spans), default=None),
                })
        return pa.array(rows, pa.struct([("n_paragraphs", pa.int64()), ("n_licences", pa.int64()), ("families", pa.string()), ("spans", pa.string()), ("probability", pa.float64())]))

    return run(text)


def license_scans(docs: DataFrame) -> DataFrame:
    """One row per document: what ``scan`` finds with a classifier fitted on a bounded sample of these documents."""
    model = fit(prose_sample(docs))
    return docs.select("doc_id", scan(F.col("text"), model, docs).alias("f")).select("doc_id", "f.*")
