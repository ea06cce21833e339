"""Licence scan by a trained paragraph classifier.

A paragraph is a run of lines with words; blank lines part them. Notices are wrapped and stand among other lines, so
each line and each window of up to the longest of SPANS lines within a paragraph is judged. Sparse hashed word uni- and
bigrams feed a multinomial logistic regression over licence families and `unknown`. It is trained here on variations of
the templates below; as unknown ones on templates whose telling words are replaced (licences it doesn't know) or that
are negated, on notices of other licences, and on a bounded sample of the corpus's own lines that match no template.
A temperature fitted on held-out variations and held-out unknown licences calibrates the probabilities. A family counts
if its probability exceeds CONFIDENT and a template confirms it: it shares enough words in order with the window, the
window holds the template's telling words, none of the unknown notices is as close, and no word denies it.
One pass without a shuffle; the model has DIMS x families numbers.

Defined results: null and empty texts and paragraphs have no licence; of equal probabilities the first family by name
wins; repeated rows are judged alike; an empty table trains on the templates alone and returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bytescan as bs
from corpusforge.llm.decontamination import FOLD, _lcs, _masks

BITS = 14
DIMS = 1 << BITS
UNKNOWN = "unknown"
CONFIDENT, SHARED = 0.6, 0.6
SAMPLE_DOCS = 1500  # documents whose paragraphs train the unknown class, at most
VARIATIONS = 40
#: Usual wordings of licence notices, by family.
TEMPLATES = {
    "agpl": ("This program is licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License version 3 or any later version."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GNU GPL, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU LGPL, version 3."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced without prior written permission.", "Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain under CC0 1.0.", "Released under the Unlicense."),
}
FAMILIES = (*TEMPLATES, UNKNOWN)
SPANS = (1, 2, 3, 4, 6, 8)  # lines of a window
#: Notices of licences outside the families, and lines that only look like notices.
STRANGERS = (
    "Licensed under the EUPL, Version 1.2 or later.", "Distributed under the Boost Software License, Version 1.0.", "Released under the zlib License.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "The contents of this file are subject to the Common Development and Distribution License.", "Licensed under the Artistic License 2.0.", "Released under the WTFPL, version 2.", "Licensed under the Open Software License version 3.0.",
    "A driver's license is required to rent a car.", "The license fee is due every year.", "See the license file for details of your rights.", "All rights and duties are reserved for the members of the council.",
)
DENIALS = ("not", "never", "no", "cannot")


class Paragraphs:
    """Lines with words of one slice, their hashed uni- and bigrams, and the windows of successive lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        folded = FOLD[data]
        edge = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
        start, end, before = bs.word_bounds(folded, edge)
        self.hash = bs.word_hashes(folded, start, end)
        n = np.diff(before)
        used = np.flatnonzero(n)
        self.first, self.n = before[:-1][used], n[used]
        self.row = np.searchsorted(offsets, edge[:-1][used], "right") - 1
        # A line without words, or another document, ends a paragraph.
        fresh = np.ones(len(used), bool)
        fresh[1:] = (used[1:] != used[:-1] + 1) | (self.row[1:] != self.row[:-1])
        self.paragraph = np.cumsum(fresh) - 1
        place = np.arange(len(self.hash)) - np.repeat(self.first, self.n)
        one = self.hash >> bs.U64(64 - BITS)
        two = np.concatenate((self.hash[:1], bs.mix(self.hash[1:] + bs.U64(7) * self.hash[:-1], 6))) >> bs.U64(64 - BITS)
        self.dims = np.stack((one, np.where(place > 0, two, one)), 1).astype(np.int64)

    def windows(self, span: int) -> np.ndarray:
        """First lines of the windows of `span` lines that stay within a paragraph."""
        at = np.arange(max(len(self.first) - span + 1, 0))
        return at[self.paragraph[at] == self.paragraph[at + span - 1]]

    def scores(self, table: np.ndarray, bias: np.ndarray, at: np.ndarray | None = None, span: int = 1) -> np.ndarray:
        """Mean of the weights of a window's events, times the root of their number, plus bias."""
        if not len(self.first):
            return np.zeros((0, len(bias)))
        at = np.arange(len(self.first)) if at is None else at
        if not hasattr(self, "sums") or self.table is not table:
            lines = np.add.reduceat(table[self.dims[:, 0]] + table[self.dims[:, 1]], self.first, axis=0)
            self.sums = np.concatenate((np.zeros((1, len(bias))), np.cumsum(lines, axis=0, dtype=np.float64)))
            self.total, self.table = np.concatenate(([0], np.cumsum(self.n))), table
        n = self.total[at + span] - self.total[at]
        return (self.sums[at + span] - self.sums[at]) / np.sqrt(2.0 * n)[:, None] + bias

    def words(self, i: int, span: int = 1) -> list[int]:
        return self.hash[self.first[i] : self.first[i + span - 1] + self.n[i + span - 1]].tolist()

    def lead(self, i: int) -> list[int]:
        """The three words of the paragraph before line i."""
        if i == 0 or self.paragraph[i - 1] != self.paragraph[i]:
            return []
        return self.hash[max(self.first[i] - 3, self.first[i - 1]) : self.first[i]].tolist()


class Model:
    def __init__(self, table: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.table, self.bias, self.temperature = table, bias, temperature
        hashed = lambda ts: [p.words(i) for p in [_paragraphs([t.encode() for t in ts])] for i in range(len(ts))]
        self.words = {f: hashed(ts) for f, ts in TEMPLATES.items()}
        self.masks = {f: [_masks(w) for w in ws] for f, ws in self.words.items()}
        self.telling = {f: [set(hashed([" ".join(_telling(t)) or "-"])[0]) if _telling(t) else set() for t in ts] for f, ts in TEMPLATES.items()}
        self.strangers = [(w, _masks(w)) for w in hashed(STRANGERS)]
        self.denials = set(hashed([" ".join(DENIALS)])[0])

    def probabilities(self, p: Paragraphs, at: np.ndarray | None = None, span: int = 1) -> np.ndarray:
        z = p.scores(self.table, self.bias, at, span) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return z / z.sum(1, keepdims=True) if len(z) else z

    def confirms(self, family: str, words: list[int], lead: list[int]) -> bool:
        """Whether a template of the family shares enough words in order with the window, and nothing speaks against it."""
        held, denied = set(words), sum(x in self.denials for x in [*lead, *words])
        best = 0.0
        for w, m, telling in zip(self.words[family], self.masks[family], self.telling[family], strict=True):
            if denied > sum(x in self.denials for x in w) or 2 * len(telling & held) < len(telling):
                continue
            best = max(best, _lcs(w, m, words) / len(w))
        return best >= SHARED and all(_lcs(w, m, words) / len(w) < best for w, m in self.strangers)


def _telling(template: str) -> list[str]:
    """The template's words that few templates have: names of licences, not what all notices say."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    every = [set(split(t)) for ts in TEMPLATES.values() for t in ts] + [set(split(t)) for t in STRANGERS]
    return [w for w in dict.fromkeys(split(template)) if sum(w in x for x in every) <= 3 and len(w) > 1]


def _paragraphs(texts: list[bytes]) -> Paragraphs:
    return Paragraphs(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))


def _variations(seed: int) -> tuple[list[bytes], list[int]]:
    """Templates with words dropped and strange ones put in, as line breaks, names and years do."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for y, ts in enumerate(TEMPLATES.values()):
        for t in ts:
            for v in range(VARIATIONS):
                words = [w for w in t.split() if v == 0 or rng.random() > 0.06]
                if v % 3 == 1:
                    words = [*(f"x{rng.integers(1 << 30)}" for _ in range(rng.integers(1, 5))), *words, *(f"y{rng.integers(1 << 30)}" for _ in range(rng.integers(0, 4)))]
                texts.append((" ".join(words) or t).encode())
                labels.append(y)
    return texts, labels


def _resembles(model: Model, line: bytes, close: set[int]) -> bool:
    """Whether a line of the corpus holds a template, so that it mustn't train the unknown class."""
    p = _paragraphs([line])
    words = p.words(0) if len(p.first) else []
    return bool(close & set(words)) and any(model.confirms(f, words, []) for f in TEMPLATES)


def _unknown(seed: int) -> list[bytes]:
    """Notices of no family: other licences, templates with strange words for the telling ones, and denials."""
    rng = np.random.default_rng(seed)
    out = list(STRANGERS[seed % 2 :: 2]) * 8
    for ts in TEMPLATES.values():
        for t in ts:
            telling = set(_telling(t))
            for v in range(6):
                words = [f"z{rng.integers(1 << 30)}" if "".join(c for c in w.lower() if c.isalnum()) in telling or any(x in telling for x in w.lower().replace("-", " ").replace(".", " ").split()) else w for w in t.split()]
                out.append(" ".join(words))
                if v < 2:
                    cut = int(rng.integers(0, max(1, min(4, len(t.split())))))
                    out.append(" ".join([*t.split()[:cut], DENIALS[v], *t.split()[cut:]]))
    return [t.encode() for t in out]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS, rounds: int = 150) -> Model:
    total = docs.count()
    share = min(1.0, 1.2 * sample / max(1, total))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(31), docs[id_col], docs[text_col]), 1)
    few = docs.where(h < F.lit(min((1 << 63) - 1, int(share * 2**63)))).orderBy(h, docs[id_col]).select(docs[text_col].cast("string").alias("t")).limit(sample).toArrow()["t"].to_pylist()  # the same ones in every run
    lines = [line.encode() for t in few if t for line in t.split("\n") if line.strip()]
    blank = Model(np.zeros((DIMS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES)), 1.0)
    close = {x for ws in blank.telling.values() for t in ws for x in t}
    plain = [x for x in lines if not _resembles(blank, x, close)]
    parts = []
    for seed, own in ((1, plain[::2]), (2, plain[1::2])):
        texts, labels = _variations(seed)
        others = _unknown(seed) + own
        p = _paragraphs(texts + others)
        # Lines without a word vanish; their rows say which label each has.
        parts.append((p, np.array(labels + [len(FAMILIES) - 1] * len(others))[p.row]))
    p, y = parts[0]
    k = len(FAMILIES)
    table, bias = np.zeros((DIMS, k), np.float32), np.zeros(k)
    if len(y):
        count = np.bincount(y, minlength=k)
        weight = (1.0 / np.maximum(count, 1))[y]
        weight *= len(y) / weight.sum()
        owner = np.repeat(np.repeat(np.arange(len(p.n)), p.n), 2)
        flat, root = p.dims.ravel(), np.sqrt(2.0 * p.n)
        # Only dimensions that occur can move.
        used, at = np.unique(flat, return_inverse=True)
        w, v, vb = np.zeros((len(used), k)), np.zeros((len(used), k)), np.zeros(k)
        order = np.argsort(at, kind="stable")
        edge = np.searchsorted(at[order], np.arange(len(used)))
        for _ in range(rounds):
            z = np.add.reduceat(w[at], 2 * p.first, axis=0) / root[:, None] + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z *= weight[:, None] / len(y)
            g = np.add.reduceat((z / root[:, None])[owner[order]], edge, axis=0)
            v, vb = 0.9 * v - 3.0 * (g + 1e-6 * w), 0.9 * vb - 3.0 * z.sum(0)
            w, bias = w + v, bias + vb
        table[used] = w
    p, y = parts[1]

    def loss(t: float) -> float:
        z = p.scores(table, bias) / t
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    return Model(table, bias, temperature)


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, license (the most probable confirmed family or null), score, licenses, and
    n_paragraphs (paragraphs with a notice, once for each family)."""
    box = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x families numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = box.value
        for batch in batches:
            for a, b, data, offsets in bs.slices(batch.column(1), bs.SLICE // 2):
                p = Paragraphs(data, offsets)
                found: list[dict[str, float]] = [{} for _ in range(b - a)]
                seen: set[tuple[int, str]] = set()  # paragraphs and families that are settled
                n = np.zeros(b - a, np.int64)
                for span in SPANS:
                    at = p.windows(span)
                    prob = m.probabilities(p, at, span)
                    if not len(prob):
                        break
                    for k in np.flatnonzero((prob.argmax(1) < len(FAMILIES) - 1) & (prob.max(1) >= CONFIDENT)):
                        i, family, value = int(at[k]), FAMILIES[int(prob[k].argmax())], float(prob[k].max())
                        r, key = int(p.row[i]), (int(p.paragraph[i]), family)
                        if value <= found[r].get(family, 0.0) and key in seen or not m.confirms(family, p.words(i, span), p.lead(i)):
                            continue
                        n[r] += key not in seen
                        seen.add(key)
                        found[r][family] = max(value, found[r].get(family, 0.0))
                best = [min(f, key=lambda x: (-f[x], x)) if f else None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(best, pa.string()), pa.array([f[x] if x else 0.0 for f, x in zip(found, best, strict=True)], pa.float64()), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(n)],
                    ["doc_id", "license", "score", "licenses", "n_paragraphs"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return text.mapInArrow(judge, f"doc_id {kind}, license string, score double, licenses array<string>, n_paragraphs long")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs)).withColumn("licenses", F.array_join("licenses", ","))
