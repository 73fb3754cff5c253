"""Licence scans: a trained classifier of paragraphs, confirmed by templates.

A paragraph is a line that isn't blank; notices are also looked for in joins of neighbouring ones, for they are often
wrapped. A join begins at each line and goes on within the block of lines that aren't blank until it has, behind its
first line, as many words as the longest notice. Of joins and single lines that overlap, the one that is nearest to
a notice counts, of equally near ones the one of the fewest lines, then the first. A multinomial logistic regression over word 1- and 2-grams, with an L1 term,
tells licence families and "unknown" apart. It is trained here on notices of the families below, with words dropped
and foreign words around them, against sentences that only mention such words and a bounded sample (NEGATIVES) of the
corpus's own lines (of at most LINE characters). Its probabilities are calibrated by a temperature on notices that the
model hasn't seen; a paragraph whose calibrated probability is under LIKELY is unknown. A predicted family counts only
if one of its notices shares at least SIMILAR of its word 2-grams with the paragraph, which must also have half of the
words that tell this notice from other families', and if no other family's notice shares more.

Defined results: null and empty text have no paragraph and no licence; repeated rows are scanned alike; an empty table
gives an empty result (the model is then trained without lines of a corpus); other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csift.llm.common import hash_sample, slices
from csift.llm.linear import Rows, fit_softmax, softmax

#: Lines of the corpus that the model is trained on at most, and the characters of the longest of them.
NEGATIVES = 400
LINE = 2000
LIKELY = 0.5
SIMILAR = 0.6
VARIANTS = 24
SHRINK = 2e-4
UNKNOWN = "unknown"

#: Usual notices of licence families.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT software license, see the accompanying file COPYING",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "Released under the GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
}
#: Sentences that only sound like notices.
MENTIONS = [
    "He lost his driving license in the spring of last year.",
    "The software was released under pressure from the board.",
    "Permission to enter the building was granted by the guard.",
    "The version of the story published in the paper was wrong.",
    "A general in the public eye seldom speaks free of charge.",
    "This work is the result of many years in the archive.",
    "The terms of the contract were not published.",
    "Licensed dealers may sell the copy under their own name.",
    "You may obtain tickets at the gate in the evening.",
    "All rights to the house were waived by the author of the will.",
    "The foundation was free to modify the plan as it pleased.",
    "Source and binary stars were distributed over the sky.",
    "The commons were open to any person with a dog.",
    "The conditions of use are posted on the door.",
    "An international conference on attribution of art was held in May.",
    "Copies of the document are kept in the file of the court.",
    "MIT is a university in Massachusetts.",
    "The Apache are a people of the south west.",
    "Mozilla was the name of a monster in the film.",
    "The library is free and open to the public.",
]
WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")


def grams(paragraph: str) -> set[str]:
    words = WORDS.findall(paragraph.lower())
    return {*words, *map(" ".join, zip(words, words[1:]))}


def pairs(paragraph: str) -> frozenset[tuple[str, str]]:
    words = ["^", *WORDS.findall(paragraph.lower())]
    return frozenset(zip(words[1:], words[2:])) or frozenset(zip(words, words[1:]))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


TEMPLATES = {family: [pairs(x) for x in notices] for family, notices in NOTICES.items()}
#: Words of a notice that no other family's notices have: half of them must stand in what it confirms.
TELLING = {
    family: [frozenset(words_of(x)) - {w for other, more in NOTICES.items() if other != family for y in more for w in words_of(y)} for x in notices]
    for family, notices in NOTICES.items()
}
EVERY_PAIR = frozenset(x for notices in TEMPLATES.values() for notice in notices for x in notice)
LONGEST = max(len(words_of(x)) for notices in NOTICES.values() for x in notices)


def near_a_notice(held: set[tuple[str, str]]) -> bool:
    """Whether these word 2-grams can confirm any family."""
    return any(len(held & x) / len(x) >= SIMILAR for notices in TEMPLATES.values() for x in notices)


def similarities(paragraph: str) -> dict[str, float]:
    """For each family the largest part of a notice's word 2-grams that the paragraph has, of notices whose telling words it has."""
    held, found = pairs(paragraph), frozenset(words_of(paragraph))
    return {
        family: max(len(held & x) / len(x) if 2 * len(found & telling) >= len(telling) else 0.0 for x, telling in zip(notices, TELLING[family]))
        for family, notices in TEMPLATES.items()
    }


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    index: dict[str, int]
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float

    def probabilities(self, found: set[str]) -> np.ndarray:
        rows = [self.index[t] for t in sorted(self.index.keys() & found)]
        return softmax((self.weights[rows].sum(0) + self.intercepts) / self.temperature)

    def family(self, paragraph: str) -> tuple[str, float, float]:
        """The family (or unknown), its calibrated probability, and the similarity to its nearest notice."""
        found = grams(paragraph)
        if self.index.keys().isdisjoint(found):
            return UNKNOWN, 1.0, 0.0
        mass = self.probabilities(found)
        best = int(mass.argmax())
        name = self.families[best]
        if name == UNKNOWN or mass[best] < LIKELY:
            return UNKNOWN, float(mass[self.families.index(UNKNOWN)]), 0.0
        alike = similarities(paragraph)
        confirmed = SIMILAR <= alike[name] == max(alike.values())
        return (name if confirmed else UNKNOWN, float(mass[best]), alike[name])


class Examples:
    """Notices with words dropped and foreign words around them, and texts that are none."""

    def __init__(self, lines: list[str], seed: int):
        self.chance = np.random.default_rng(seed)
        self.plain = sorted({x for x in lines if max(similarities(x).values()) < 0.4}) or MENTIONS
        self.foreign = [w for x in self.plain for w in x.split()]

    def varied(self, text: str) -> str:
        chance, foreign = self.chance, self.foreign
        words = [w for w in text.split() if chance.random() > 0.06]
        around = [foreign[i] for i in chance.integers(0, len(foreign), chance.integers(0, 9))] if chance.random() < 0.5 else []
        half = int(chance.integers(0, len(around) + 1))
        return " ".join([*around[:half], *words, *around[half:]])

    def made(self, notices: dict[str, list[str]], others: list[str]) -> tuple[list[set[str]], np.ndarray]:
        """Terms and classes; the classes are unknown, then those of NOTICES."""
        found, classes = [], []
        for k, family in enumerate(NOTICES, 1):
            for notice in notices.get(family, ()):
                found += [grams(notice), *(grams(self.varied(notice)) for _ in range(VARIANTS - 1))]
                classes += [k] * VARIANTS
        for text in others:
            found += [grams(text), *(grams(self.varied(text)) for _ in range(6 if text in MENTIONS else 0))]
        return found, np.array(classes + [0] * (len(found) - len(classes)))


def fitted(found: list[set[str]], classes: np.ndarray) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    counts: dict[str, int] = {}
    for terms in found:
        for t in terms:
            counts[t] = counts.get(t, 0) + 1
    index = {t: i for i, t in enumerate(sorted(t for t, n in counts.items() if n >= 4))}
    weights, intercepts = fit_softmax(Rows.of([sorted(t) for t in found], index), classes, len(NOTICES) + 1, SHRINK)
    kept = np.abs(weights).max(1) > 1e-4
    index = {t: i for i, t in enumerate(t for t, i in sorted(index.items(), key=lambda x: x[1]) if kept[i])}
    return index, weights[kept], intercepts


def train(lines: list[str], seed: int = 3) -> Model:
    """lines: of the corpus; those that resemble a notice are left out.

    The temperature is the one at which a model that hasn't seen a family's last notices, nor half of the others'
    texts, is most likely right about them; the model itself learns from all.
    """
    examples = Examples(lines, seed)
    others = [*MENTIONS, *examples.plain]
    seen = {f: x[: -max(1, len(x) // 3)] for f, x in NOTICES.items()}
    unseen = {f: x[len(seen[f]) :] for f, x in NOTICES.items()}
    index, weights, intercepts = fitted(*examples.made(seen, others[::2]))
    found, classes = examples.made(unseen, others[1::2])
    margins = Rows.of([sorted(t) for t in found], index).times(weights) + intercepts
    losses = {t: -np.log(np.maximum(softmax(margins / t)[np.arange(len(classes)), classes], 1e-12)).mean() for t in np.geomspace(0.2, 5, 33)}
    index, weights, intercepts = fitted(*examples.made(NOTICES, others))
    return Model((UNKNOWN, *NOTICES), index, weights, intercepts, float(min(losses, key=losses.get)))


def sample_lines(docs: DataFrame, sample: int = NEGATIVES, longest: int = LINE) -> list[str]:
    """Of `sample` documents, chosen by a hash, the line that a hash of the document points to, of lines of at most `longest` characters."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: (F.trim(x) != "") & (F.length(x) <= longest))
    chosen = hash_sample(docs.select("doc_id", "text"), "doc_id", sample).filter(F.length(F.trim("text")) > 0).withColumn("_h", F.xxhash64("text"))
    line = F.get(lines, F.pmod(F.col("_h"), F.greatest(F.size(lines), F.lit(1))).cast("int"))
    return [x[0] for x in chosen.select(line).distinct().collect() if x[0]]


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Where lines that aren't blank begin and end."""
    return [m.span() for m in re.finditer(r"[^\n]+", text) if not m[0].isspace()]


def blocks(text: str, lines: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of lines with no blank line between them."""
    begin = 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or text.count("\n", lines[k - 1][1], lines[k][0]) > 1:
            yield lines[begin:k]
            begin = k


def joins(text: str, block: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """First and last line of the joins, single lines too, that hold enough of a notice, and each line of which adds to one."""
    words = [words_of(text[b:e]) for b, e in block]
    inner = [EVERY_PAIR.intersection(zip(w, w[1:])) for w in words]
    flat = [(k, w) for k, line in enumerate(words) for w in line]
    across: dict[int, tuple[str, str]] = {}  # by the line of the second word
    for (k, a), (j, b) in zip(flat, flat[1:]):
        if k != j and (a, b) in EVERY_PAIR:
            across[j] = (a, b)
    if not near_a_notice({*across.values()}.union(*inner)):
        return
    worded = [k for k, line in enumerate(words) if line]  # each step inwards takes a word or more, so the work is linear
    for a, i in enumerate(worded):
        held, behind, at = set(inner[i]), 0, a + 1
        if held and near_a_notice(held):
            yield i, i
        while at < len(worded) and behind < LONGEST:
            j, before, at = worded[at], len(held), at + 1
            held |= inner[j]
            if j in across:
                held.add(across[j])
            behind += len(words[j])
            if len(held) > before and near_a_notice(held):
                yield i, j


def notices_in(model: Model, text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int, str, float, float]]:
    """(begin, end, family, probability, similarity) of what counts, in order."""
    out = []
    for block in blocks(text, lines):
        named = [(i, j, *model.family(text[block[i][0] : block[j][1]])) for i, j in joins(text, block)]
        taken: set[int] = set()
        for i, j, family, mass, alike in sorted((x for x in named if x[2] != UNKNOWN), key=lambda x: (-x[4], x[1] - x[0], x[0])):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                out.append((block[i][0], block[j][1], family, mass, alike))
    return sorted(out)


def license_scan(docs: DataFrame, sample: int = NEGATIVES) -> DataFrame:
    """doc_id, n_paragraphs, n_licenses, families (distinct, sorted) and found of each row.

    found: array of (begin, end, family, probability, similarity), places in code points.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample_lines(docs, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
        for part in slices(batches, "text"):
            counts, hits = [], []
            for text in part.column("text").to_pylist():
                spans = paragraphs(text or "")
                counts.append(len(spans))
                named = notices_in(model.value, text or "", spans)
                hits.append([dict(zip(("begin", "end", "family", "probability", "similarity"), x)) for x in named])
            families = [sorted({x["family"] for x in h}) for h in hits]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(map(len, hits), pa.int64()), pa.array(families, pa.list_(pa.string())), pa.array(hits, kind)],
                ["doc_id", "n_paragraphs", "n_licenses", "families", "found"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = "array<struct<begin:int,end:int,family:string,probability:double,similarity:double>>"
    return rows.mapInArrow(run, f"doc_id long, n_paragraphs long, n_licenses long, families array<string>, found {found}")
