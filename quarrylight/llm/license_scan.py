"""Licence scans: a trained paragraph classifier, its unknown class calibrated, its predictions confirmed by templates.

A sparse logistic regression over word 1- to 3-grams tells the families of licence notices, and text that is none. It is
trained here: on variations of the templates below and on a bounded sample of the corpus's own paragraphs that share no
3-gram with a template. A temperature fitted on a held-out quarter calibrates its probabilities. A paragraph whose best family is not
probable enough, or whose words do not agree with a template of that family, is `unknown` if that class's own calibrated
probability, or a partial agreement with some template, makes it a licence at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import textkit
from quarrylight.llm.common import fresh

#: Short notices of licence families. Fixed values.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License",
        "Apache License Version 2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "The MIT License (MIT)",
        "Licensed under MIT",
    ],
    "bsd": [
        "Distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD License",
        "BSD 3-Clause License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Ltd. All rights reserved.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Words around a notice in its variations. Fixed values.
AROUND = "this document page file project text website article notice see more details for the and of by our under terms please copyright 2019 2021 2023 author team version software content data".split()
#: Notices of families that the templates lack: they should come out as unknown. Fixed values.
FOREIGN = [
    "Licensed under the Eclipse Public License, version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This work is licensed under the Open Database License.",
    "Released under the Artistic License.",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "Released under the zlib license.",
    "This library is licensed under the Common Development and Distribution License.",
]
#: Sentences that use the words of notices in other senses: they are no licences. Fixed values.
ORDINARY = [
    "He forgot his driving licence at home and had to walk.",
    "The fishing license costs more for visitors than for people from the village.",
    "They argued about the rights of workers in the old factory.",
    "The restaurant got its license to serve wine last spring.",
    "Women won the right to vote and fought for equal rights.",
    "The copyright office is on the second floor of the building.",
    "A licensed electrician came to look at the house.",
    "You may use the kitchen free of charge until noon.",
    "The general public was asked to keep out of the source of the river.",
    "Her pilot licence was renewed without any conditions.",
    "The law grants permission to build under certain terms.",
    "Version two of the story was distributed to the class.",
]
NONE, UNKNOWN = "none", "unknown"
FEATURES = 1 << 17
#: Variations of each template; paragraphs of the corpus in the training sample at most, from so many documents at most.
VARIATIONS = 60
SAMPLE, SAMPLE_DOCS = 2_000, 400
#: A line of more words is read in windows of so many, each half over the one before.
WINDOW = 48
#: Least share of the words of some template that a confirmed paragraph has in common with it (3-grams; both directions).
AGREEMENT = 0.5
CONFIDENT = 0.7
#: What makes a paragraph that no template confirms a licence of an unknown family: so much calibrated probability of that
#: class, or so large a share in common with some template.
UNKNOWN_LEAST = 0.6
RELATED = 0.25
_BYTE = np.full(256, 0x20, np.uint8)
_BYTE[0x80:] = np.arange(0x80, 0x100)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _BYTE[_c] = _c
    if _c > 0x60:
        _BYTE[_c - 0x20] = _c


def units(texts: pa.Array) -> tuple[textkit.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the lines of all texts; and each unit's document, first word and end. Lower case, without signs."""
    buf, off = textkit.raw(texts)
    line = np.flatnonzero(buf == 10)
    bound = np.unique(np.r_[off, line + 1]).astype(np.int64)
    w = textkit.words_of(_BYTE[buf], bound if len(buf) else np.zeros(1, np.int64))
    n = np.diff(w.first)
    owner = np.searchsorted(off[1:], bound[:-1], side="right")
    some = np.flatnonzero(n)
    pieces = np.maximum(1, -(-(n[some] - WINDOW // 2) // (WINDOW // 2)))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(some, pieces)
    a = w.first[:-1][at] + nth * (WINDOW // 2)
    b = np.minimum(a + WINDOW, w.first[1:][at])
    return w, owner[at], a, b


def grams(w: textkit.Words) -> list[np.ndarray]:
    """Feature of the 1-, 2- and 3-gram that begins at each word; -1 where it would cross a line's end."""
    out = []
    end = np.repeat(w.first[1:], np.diff(w.first))
    place = np.arange(len(w.hash))
    for k in (1, 2, 3):
        f = np.full(len(w.hash), -1, np.int64)
        h = textkit.runs(w.hash, k, seed=30 + k)
        f[: len(h)] = (h >> np.uint64(47)).astype(np.int64)
        f[place + k > end] = -1
        out.append(f)
    return out


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # features + 1 (zeros, for no feature) x classes
    bias: np.ndarray
    temperature: float

    def probabilities(self, w: textkit.Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each unit and class. A unit's score is the sum of its grams' weights by the root of their number."""
        each = np.zeros((len(w.hash) + 1, len(self.classes)))
        if len(w.hash):
            each[1:] = sum(self.weights[f] for f in grams(w))
        np.cumsum(each, axis=0, out=each)
        z = (each[b] - each[a]) / np.sqrt(np.maximum(1, 3 * (b - a)))[:, None] + self.bias
        z = z / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def _words(text: str) -> list[str]:
    return bytes(_BYTE[np.frombuffer(text.encode(), np.uint8)]).decode().split()


def _variations(seed: int = 9) -> tuple[list[str], list[str]]:
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for label, templates in [*TEMPLATES.items(), (UNKNOWN, FOREIGN), (NONE, ORDINARY)]:
        for t in templates:
            words = _words(t)
            for v in range(VARIATIONS):
                some = [x for x in words if v == 0 or rng.random() > 0.05]
                if v % 3 == 2 and len(some) > 12:
                    k = int(rng.integers(10, len(some)))
                    at = int(rng.integers(0, len(some) - k + 1))
                    some = some[at : at + k]
                before, after = (list(rng.choice(AROUND, int(rng.integers(0, 6)))) if v % 2 else [] for _ in range(2))
                texts.append(" ".join([*before, *some, *after]))
                labels.append(label)
    return texts, labels


def sample(docs: DataFrame, text: str = "text") -> list[str]:
    """Up to SAMPLE paragraphs of up to SAMPLE_DOCS documents, chosen by hash, that share no 3-gram with a template."""
    body = F.col(text).cast("string")
    chosen = docs.select(F.xxhash64(body).alias("t"), body.alias("text")).where("text is not null")
    least = chosen.select("t").distinct().orderBy("t").limit(SAMPLE_DOCS)
    lines = chosen.join(F.broadcast(least), "t").select(F.explode(F.split("text", "\n")).alias("line")).select(F.array_join(F.slice(F.split("line", " "), 1, WINDOW), " ").alias("line"))
    found = lines.where("line <> ''").distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE).collect()
    known = {tuple(w[i : i + 3]) for group in [*TEMPLATES.values(), FOREIGN] for t in group for w in [_words(t)] for i in range(max(1, len(w) - 2))}
    out = []
    for r in found:
        w = _words(r["line"])
        if w and not any(tuple(w[i : i + 3]) in known for i in range(max(1, len(w) - 2))):
            out.append(" ".join(w))
    return out


def train(negatives: list[str], rounds: int = 100) -> Model:
    """Softmax regression by gradient steps on the training texts; every fourth is held out for the temperature."""
    texts, labels = _variations()
    texts += negatives + [" ".join(AROUND[i : i + 8]) for i in range(len(AROUND) - 8)]
    labels += [NONE] * (len(texts) - len(labels))
    classes = [NONE, UNKNOWN, *TEMPLATES]
    y = np.array([classes.index(x) for x in labels])
    w, doc, a, b = units(pa.array(texts))
    keep = np.r_[True, doc[1:] != doc[:-1]]  # the first window of each text
    doc, a, b = doc[keep], a[keep], b[keep]
    y = y[doc]
    row, feature = [], []
    owner = np.repeat(np.arange(len(a)), b - a)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    for f in grams(w):
        row.append(owner[f[at] >= 0])
        feature.append(f[at][f[at] >= 0])
    row, feature = np.concatenate(row), np.concatenate(feature)
    order = np.argsort(row, kind="stable")
    row, feature = row[order], feature[order]
    used, n_used = np.unique(feature, return_counts=True)
    used = used[n_used > 2]
    often = np.isin(feature, used)
    row, feature = row[often], feature[often]
    used, col = np.unique(feature, return_inverse=True)
    value = (1 / np.sqrt(np.maximum(1, 3 * (b - a))))[row]
    weights, bias = np.zeros((len(used), len(classes))), np.zeros(len(classes))
    has, first = np.unique(row, return_index=True)
    by_col = np.argsort(col, kind="stable")
    col_first = np.searchsorted(col[by_col], np.arange(len(used)))
    fit = np.arange(len(a)) % 4 != 3
    share = (fit / np.maximum(1, np.bincount(y[fit], minlength=len(classes)))[y])[:, None]  # classes weigh the same

    def scores() -> np.ndarray:
        z = np.zeros((len(a), len(classes)))
        z[has] = np.add.reduceat(weights[col] * value[:, None], first, axis=0)
        return z + bias

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    target = np.eye(len(classes))[y]
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(rounds):
        error = (softmax(scores()) - target) * share
        step = np.add.reduceat((error[row] * value[:, None])[by_col], col_first, axis=0) + 1e-5 * weights
        speed_w, speed_b = 0.9 * speed_w - 4.0 * step, 0.9 * speed_b - 0.5 * error.sum(0)
        weights, bias = weights + speed_w, bias + speed_b
    z, held = scores(), ~fit
    losses = {t: -np.log(softmax(z[held] / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    table = np.zeros((FEATURES + 1, len(classes)), np.float32)
    table[used] = weights
    table[-1] = 0
    return Model(classes, table, bias, min(losses, key=losses.get))


def _trigrams(words: list[str]) -> set:
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or {tuple(words)}


KNOWN = {family: [_trigrams(_words(t)) for t in templates] for family, templates in TEMPLATES.items()}


def agreement(words: list[str], family: str) -> float:
    """Largest share of a template's 3-grams that the words have, or of the words' 3-grams that the template has if the words
    are at least eight."""
    own = _trigrams(words)
    return max(max(len(own & t) / len(t), len(own & t) / len(own) if len(words) >= 8 else 0.0) for t in KNOWN[family])


def decide(model: Model, w: textkit.Words, buf: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit as an index of model.classes, probability of not being `none`)."""
    p = model.probabilities(w, a, b)
    licensed = 1 - p[:, 0]
    kind = np.zeros(len(a), np.int64)
    for u in np.flatnonzero(licensed >= 0.5).tolist():
        best = int(p[u, 2:].argmax()) + 2
        words = [buf[x:y].decode(errors="replace") for x, y in zip(w.start[a[u] : b[u]].tolist(), w.end[a[u] : b[u]].tolist(), strict=True)]
        sure = p[u, best] >= CONFIDENT * licensed[u] and agreement(words, model.classes[best]) >= AGREEMENT
        if sure:
            kind[u] = best
        elif p[u, 1] >= UNKNOWN_LEAST or max(agreement(words, f) for f in TEMPLATES) >= RELATED:
            kind[u] = 1
    # a window that holds a part of a notice that the next or the last window confirms says nothing of its own
    overlap = np.r_[False, a[1:] < b[:-1]]
    sure = kind > 1
    kind[(kind == 1) & (np.r_[False, sure[:-1]] & overlap | np.r_[sure[1:], False] & np.r_[overlap[1:], False])] = 0
    return kind, licensed


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with licences (array of struct family, n, score, by family), n_units and n_licence_units.

    Null and blank texts have no units. Every line of every whole text is classified. Rows that repeat a doc_id are scanned
    each on its own. Columns of docs with those names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("licences", "n_units", "n_licence_units")]
    body = fresh("body", docs)
    ready = docs.select(*kept, F.col(text).cast("string").alias(body))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("family", pa.string()), ("n", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for piece in textkit.chunks(batch, body, 1 << 20):
                w, doc, a, b = units(piece.column(body))
                found, score = decide(m, w, w.buf.tobytes(), a, b)
                out: list[dict[str, list]] = [{} for _ in range(piece.num_rows)]
                for u in np.flatnonzero(found).tolist():
                    one = out[int(doc[u])].setdefault(m.classes[found[u]], [0, 0.0])
                    one[0] += 1
                    one[1] = max(one[1], float(score[u]))
                rows = [[{"family": f, "n": n, "score": s} for f, (n, s) in sorted(o.items())] for o in out]
                total = np.bincount(doc, minlength=piece.num_rows)
                hits = np.bincount(doc[found > 0], minlength=piece.num_rows)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(rows, kind), pa.array(total), pa.array(hits)], names=[*kept, "licences", "n_units", "n_licence_units"])

    found = T.ArrayType(T.StructType().add("family", "string").add("n", "long").add("score", "double"))
    fields = T.StructType(ready.drop(body).schema.fields).add("licences", found).add("n_units", "long").add("n_licence_units", "long")
    return ready.mapInArrow(run, fields)
