"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are runs of non-blank lines.  Each line of a paragraph and the windows of lines that begin
with it are classified by a sparse word n-gram logistic regression, one score per licence family, trained
on variants of each family's notices against a bounded sample of the corpus's own distinct lines, so that
the unknown class is what the corpus looks like.  The unknown threshold of a family is calibrated on
whole templates that were not learned from.  A predicted window is confirmed on its joined text, so that a
wrapped notice counts as an unwrapped one: enough of the word pairs of a family's template must be in it,
and the words that tell the family from its neighbours (version, "lesser") too; the family of the largest
share names it, and without one it is unknown.

Defined cases: null, empty and blank texts have no paragraphs; a line belongs to one notice at most, and
a paragraph can have several; repeated rows are scanned each; with an empty corpus the model is trained
on the templates alone; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import ngram_model, words

#: Lines of the corpus learned from as unknown, at most; weights of a family: 2 ** BITS.
SAMPLE, BITS = 4000, 16
#: Characters of a word in that sample, at most.
LONGEST = 64
#: Share of a template's word pairs that a window must show.
CONFIRM = 0.6
#: Words that windows reach at least, besides those of one and of two lines; the longest template has 43.
REACH = (12, 24, 48, 96)

# Notices of common licences, as their publishers word them.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-only"],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Released under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
    "all-rights-reserved": ["All rights reserved.", "Copyright holders reserve all rights. No part of this publication may be reproduced without prior written permission."],
}
FAMILIES = sorted(TEMPLATES)
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_V2, _V3 = (rf"\bv(?:ersion )?{n}(?:\.0)?(?= |$)|gpl-?v?{n}(?:\.0)?(?=[ -]|$)" for n in (2, 3))
_V21 = r"\bv(?:ersion )?2\.1(?= |$)|gpl-?v?2\.1(?=[ -]|$)"
_END = r"(?= |-\d|$)"
#: What must all be found in the words of a text, where a neighbour shares most word pairs.
MUST = {
    "apache-2.0": (r"\bapache(?! license (?:version |v)?1\.)(?!-1)",),
    "mit": (r"\bmit\b|person obtaining a copy",),
    "isc": (r"\bisc\b|with or without fee",),
    "bsd": (r"\bbsd\b|binary forms",),
    "gpl-2.0": (r"\bgnu general public license|\bgpl", _V2),
    "gpl-3.0": (r"\bgnu general public license|\bgpl", _V3),
    "lgpl-2.1": (r"\blesser general public license|\blgpl", _V21),
    "lgpl-3.0": (r"\blesser general public license|\blgpl", _V3),
    "agpl-3.0": (r"\baffero general public license|\bagpl", _V3),
    "mpl-2.0": (r"\bmozilla public license|\bmpl\b", r"(?<!\d\.)\b2\.0\b|was not distributed"),
    "unlicense": (r"\bunencumbered\b|\bunlicense\b|anyone is free to copy",),
    "cc-by": (r"(?:\bcc[ -]by|\battribution)" + _END,),
    "cc-by-nc": (r"(?:\bcc[ -]by-nc|\battribution-noncommercial)" + _END,),
    "cc-by-sa": (r"(?:\bcc[ -]by-sa|\battribution-sharealike)" + _END,),
    "cc-by-nd": (r"(?:\bcc[ -]by-nd|\battribution-noderivatives)" + _END,),
    "cc-by-nc-sa": (r"(?:\bcc[ -]by-nc-sa|\battribution-noncommercial-sharealike)" + _END,),
    "cc-by-nc-nd": (r"(?:\bcc[ -]by-nc-nd|\battribution-noncommercial-noderivatives)" + _END,),
}
MUST = {family: [re.compile(r) for r in rules] for family, rules in MUST.items()}


def _pairs(w: list[str]) -> set[tuple[str, ...]]:
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def pairs(text: str) -> set[tuple[str, ...]]:
    return _pairs(WORD.findall(text.lower()))


PAIRS = {family: [pairs(t) for t in templates] for family, templates in TEMPLATES.items()}
_ANY = set().union(*(t for templates in PAIRS.values() for t in templates))


def resembles(text: str) -> float:
    """The largest share of any template's word pairs that ``text`` shows."""
    found = pairs(text) & _ANY
    return max(len(t & found) / len(t) for templates in PAIRS.values() for t in templates)


def confirmed(text: str) -> tuple[float, str | None]:
    """The largest confirmed share of a template's word pairs in ``text``, and its family; of equals the longer template."""
    w = WORD.findall(text.lower())
    found, best, joined = _pairs(w) & _ANY, (0.0, 0, None), " ".join(w)
    for family in FAMILIES if found else ():
        share, size = max((len(t & found) / len(t), len(t)) for t in PAIRS[family])
        if share >= CONFIRM and (share, size) > best[:2] and all(r.search(joined) for r in MUST.get(family, ())):
            best = (share, size, family)
    return best[0], best[2]


def variants(template: str, filler: list[str], count: int, rng: np.random.Generator) -> list[str]:
    """The template alone, and amid other words, in other case, or with a few words lost."""
    out = [template]
    for _ in range(count):
        w = template.split()
        for _ in range(int(rng.integers(0, 1 + len(w) // 6))):
            w.pop(int(rng.integers(0, len(w))))
        if filler and rng.random() < 0.6:
            before, after = (filler[int(rng.integers(0, len(filler)))].split()[: int(rng.integers(0, 12))] for _ in range(2))
            w = before + w + after
        text = " ".join(w)
        out.append(text.upper() if rng.random() < 0.1 else text.lower() if rng.random() < 0.2 else text)
    return out


class LicenseModel:
    """Weights by family, and each family's threshold of probability."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def probabilities(self, k: int, found: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The probability of family ``k`` for ranges of features."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[k][found], dtype=np.float64)])
        return ngram_model.probabilities((total[ends] - total[begins]) / np.sqrt(np.maximum(ends - begins, 1)) + self.weights[k][-1])

    def picked(self, found: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a range of features reaches the threshold of any family."""
        out = np.zeros(len(begins), dtype=bool)
        for k in range(len(FAMILIES)):
            out |= self.probabilities(k, found, begins, ends) >= self.thresholds[k]
        return out


def _features(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, data, offsets in words.slices(pa.array(texts, pa.string())):
        found, starts = ngram_model.features(words.FOLD[data], offsets, BITS)
        out += [found[a:b] for a, b in zip(starts, starts[1:])]
    return out


def sample_lines(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[str]:
    """A bounded sample of the corpus's distinct lines, of a long line a window of it.

    A hash picks lines, alike at any partitioning.  The number of distinct lines says below which hash
    enough of them lie, so that what comes to the driver does not grow with the corpus or its partitions.
    """
    lines = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line")).filter(F.length(F.trim("line")) > 0)
    hashed = lines.select("line", F.xxhash64("line").alias("hash"))
    many = hashed.select("hash").distinct().count()
    below = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, (1.2 * sample + 200) / max(1, many)) * (1 << 64)))
    w = F.split(F.trim(F.col("line")), r"\s+")
    start = F.pmod(F.col("hash"), F.greatest(F.size(w) - REACH[-1] + 1, F.lit(1))).cast("int") + 1
    window = F.array_join(F.transform(F.slice(w, start, REACH[-1]), lambda x: F.substring(x, 1, LONGEST)), " ")
    picked = hashed.filter(F.col("hash") <= F.lit(below)).groupBy("hash").agg(F.min(window).alias("line"))
    return [r.line for r in picked.orderBy("hash").limit(sample).collect()]


def examples(other: list[str], rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features of unknown lines and of variants of every template, their family (-1 unknown), and who is held out.

    Held out are whole templates, one of each family that has several, and a fifth of the unknown lines.
    """
    texts, owner, held = list(other), [-1] * len(other), (rng.random(len(other)) < 0.2).tolist()
    for k, family in enumerate(FAMILIES):
        for j, t in enumerate(TEMPLATES[family]):
            made = variants(t, other, 60, rng)
            texts += made
            owner += [k] * len(made)
            held += [j > 0 and j == len(TEMPLATES[family]) - 1] * len(made)
    return _features(texts), np.array(owner), np.array(held)


def fit(found: list[np.ndarray], owner: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weights by family, learned from the chosen rows."""
    labels = (owner[rows, None] == np.arange(len(FAMILIES))).astype(np.int64)
    return np.ascontiguousarray(ngram_model.train_many([found[i] for i in rows], labels, BITS, passes=3).T, dtype=np.float32)


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, seed: int = 11) -> LicenseModel:
    """Learn from templates and a bounded sample of the corpus's distinct lines.

    Thresholds come from a model that has not seen the held-out templates; the weights used learn from all.
    """
    other = [t for t in sample_lines(docs, text_col, sample) if resembles(t) < 0.3]
    found, owner, held = examples(other, np.random.default_rng(seed))
    ends = np.cumsum([len(f) for f in found])
    begins = ends - [len(f) for f in found]
    model = LicenseModel(fit(found, owner, np.flatnonzero(~held)), np.full(len(FAMILIES), 0.5, dtype=np.float32))
    for k in range(len(FAMILIES)):
        p = model.probabilities(k, np.concatenate(found), begins, ends)
        own, rest = p[held & (owner == k)], p[held & (owner != k)]
        # Between the least of its own and the most of all others, but never so high as to lose its own.
        low = np.quantile(own, 0.02) if len(own) else 0.5
        model.thresholds[k] = min(0.5, max(0.05, (low + (rest.max() if len(rest) else 0.0)) / 2, min(low, 0.5) * 0.5))
    model.weights = fit(found, owner, np.arange(len(found)))
    return model


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line bounds, each line's paragraph's end (0 for blank lines), which lines begin one, and windows ``from, to`` of lines."""
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    starts, _, _ = words.spans(data, offsets)
    first = np.searchsorted(starts, bounds)
    full = first[1:] > first[:-1]
    text = np.zeros(len(bounds), dtype=bool)
    text[np.searchsorted(bounds, offsets)] = True  # a text begins here
    begins = full & (text[:-1] | ~np.concatenate([[False], full[:-1]]))
    # A paragraph ends where a blank line or a text begins; every line looks for the next such place.
    stops = np.flatnonzero(np.concatenate([~full, [True]]) | text)
    line = np.flatnonzero(full)
    last = stops[np.searchsorted(stops, line, side="right")] if len(line) else line
    ends = np.zeros(len(full), dtype=np.int64)
    ends[line] = last
    reached = [line + 1, line + 2] + [np.searchsorted(first, first[line] + k) for k in REACH]
    to = np.minimum(np.maximum(np.concatenate(reached), np.tile(line + 1, len(reached))), np.tile(last, len(reached)))
    made = np.unique(np.tile(line, len(reached)) * (len(bounds) + 1) + to)
    return bounds, ends, begins, made // (len(bounds) + 1), made % (len(bounds) + 1)


def _feature_ranges(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of texts, and the range of each window: pairs reach across line ends, but not out of the window."""
    found, _ = ngram_model.features(data, offsets, BITS)
    starts, _, first = words.spans(data, offsets, by_kind=True)
    last = first[1:][first[1:] > first[:-1]] - 1  # these words begin no pair
    word = np.searchsorted(starts, bounds)
    return found, 2 * word[a] - np.searchsorted(last, word[a]), 2 * (word[b] - 1) - np.searchsorted(last, word[b] - 1) + 1


def notices(raw: bytes, bounds: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
    """``first line, line behind the last, family, share`` of the notices in windows of one text, best first where they overlap."""
    known: dict[tuple[int, int], tuple[float, str | None]] = {}

    def at(a: int, b: int) -> tuple[float, str | None]:
        if (a, b) not in known:
            known[a, b] = confirmed(raw[bounds[a] : bounds[b]].decode())
        return known[a, b]

    found = set()
    for a, b in spans:
        best = at(a, b)
        if best[1] is None:
            continue
        while b - a > 1 and at(a, b - 1) >= best:  # lines that add nothing are not of the notice
            b, best = b - 1, at(a, b - 1)
        while b - a > 1 and at(a + 1, b) >= best:
            a, best = a + 1, at(a + 1, b)
        found.add((a, b, best[1], best[0]))
    taken, out = set(), []
    for n in sorted(found, key=lambda n: (-n[3], n[1] - n[0], n)):
        if taken.isdisjoint(range(n[0], n[1])):
            taken.update(range(n[0], n[1]))
            out.append(n)
    return sorted(out)


SCAN = "id long, n_paragraphs int, families array<string>, lines array<int>, ends array<int>, shares array<double>"


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_paragraphs`` and, for each notice, family, first and last line number and confirmed share."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FAMILIES times 2 ** BITS weights

    def read(batches):
        m = sent.value
        for batch in batches:
            for at, data, offsets in words.slices(batch.column(1)):
                bounds, _, begins, a, b = windows(data, offsets)
                if len(a):
                    picked = m.picked(*_feature_ranges(words.FOLD[data], offsets, bounds, a, b))
                    a, b = a[picked], b[picked]
                first = np.searchsorted(bounds, offsets)
                count = np.concatenate([[0], np.cumsum(begins)])[first]
                own = np.searchsorted(a, first)
                raw = data.tobytes()
                found = [notices(raw, bounds, list(zip(a[i:j].tolist(), b[i:j].tolist()))) if j > i else [] for i, j in zip(own, own[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(offsets) - 1),
                        pa.array(np.diff(count), pa.int32()),
                        pa.array([[n[2] for n in f] for f in found], pa.list_(pa.string())),
                        pa.array([[n[0] - k for n in f] for f, k in zip(found, first.tolist())], pa.list_(pa.int32())),
                        pa.array([[n[1] - 1 - k for n in f] for f, k in zip(found, first.tolist())], pa.list_(pa.int32())),
                        pa.array([[n[3] for n in f] for f in found], pa.list_(pa.float64())),
                    ],
                    names=["id", "n_paragraphs", "families", "lines", "ends", "shares"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, SCAN)
