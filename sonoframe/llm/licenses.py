"""Licence statements by a trained paragraph classifier.

A paragraph (a line of the text) is cut into sentences, and long sentences into windows of ``WINDOW_WORDS`` that overlap. A
sentence is the set of its word one- and two-grams. Sparse logistic regressions over the n-grams of known statements, one for each
licence family and one for ``unknown``, licence talk of no known family, give a probability each, so one sentence may name
several families. The probabilities are calibrated by a temperature, fitted on held-out sentences. A predicted
family must then be confirmed by the family's own templates; licence talk without a confirmed family is ``unknown``.

Scanning uses built-in expressions only and stays inside rows: a bitmap of hashes tells which sentences hold an n-gram that statements
use and the corpus hardly does, however short the sentence is, so most go before any weight is looked at. Fitting is
small: it uses the templates, cut, joined and mixed with a bounded sample of sentences of the corpus
(``SAMPLE_PARAGRAPHS`` paragraphs, of long texts a run), on the driver.

Defined results: null and empty texts hold no paragraph; paragraphs and their sentences are counted from 0, blank lines
included; a family that several sentences name has a row for each; rows with a null or repeated id are scanned like any other; an
empty table gives an empty table.
"""

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sonoframe.llm.samples import excerpt

SAMPLE_PARAGRAPHS = 1500
WINDOW_WORDS, WINDOW_STEP = 64, 48
COMMON = 0.01  # of the sample's sentences: n-grams in more of them do not make a sentence worth scoring
BITS = 16
LEAST_PROBABILITY = 0.5
LEAST_SIMILARITY = 0.6  # share of a template's, or of the paragraph's, n-grams
LEAST_UNKNOWN_SIMILARITY = 0.4  # to any template of a guessed class, below which a sentence is none after all
NONE, UNKNOWN = "none", "unknown"

# How the licences ask to be named, and talk of licences without one of them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
        "Apache License 2.0",
        "Apache 2.0 licensed",
        "Apache licensed",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "License: AGPL-3.0",
        "AGPLv3",
        "AGPL",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "This code is under the BSD license.",
        "License: BSD",
        "BSD licensed",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
        "Released under CC0.",
        "CC0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "License: CC BY 4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "License: GPL-3.0",
        "Licensed under GPLv3.",
        "GPLv3",
        "GPLv2",
        "GNU GPL",
        "GPL licensed",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "License: LGPL-3.0",
        "LGPLv3",
        "LGPL",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "MIT licensed",
        "Licensed under MIT.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
        "Mozilla Public License 2.0",
        "MPLv2",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "This work is in the public domain.",
        "Dedicated to the public domain.",
        "License: public domain",
    ],
    UNKNOWN: [
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "This software is licensed under the terms of the vendor licence agreement.",
        "See the LICENSE file in the root of this project for licence terms.",
        "Licensed under a proprietary license.",
        "Use of this material is subject to the licence of its publisher.",
        "Released under a custom license.",
    ],
}


class Model(NamedTuple):
    classes: list[str]
    vocabulary: list[int]  # hashes of n-grams, sorted
    weights: np.ndarray  # (classes, vocabulary), divided by the temperature
    bias: np.ndarray
    templates: list[tuple[str, list[int]]]  # family and hashes
    telling: list[int]  # of the vocabulary, what the corpus hardly uses


def ngrams(paragraph: Column) -> Column:
    """Hashes of the distinct word one- and two-grams, lower-cased, of letters and digits."""
    tokens = F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    coded = F.transform(tokens, lambda w: F.xxhash64(w))
    pairs = bound(
        coded, lambda c: F.concat(c, F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda h, i: F.xxhash64(F.get(c, i), h)))
    )
    return F.array_distinct(pairs)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _longs(values) -> Column:
    return F.expr(f"array({', '.join(f'{int(v)}L' if v > -(1 << 63) else 'bigint(-9223372036854775808)' for v in values)})")


def _doubles(values) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def _similarity(grams: set[int], template: set[int]) -> float:
    return len(grams & template) / max(1, min(len(grams), len(template)))


def sentences(paragraph: Column) -> Column:
    """Sentences of a paragraph, long ones as overlapping windows of words."""
    def windows(sentence: Column) -> Column:
        def cut(words: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW_WORDS + WINDOW_STEP - 1, F.lit(0)), F.lit(WINDOW_STEP))
            return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(WINDOW_WORDS)), " "))

        return bound(F.split(sentence, r"\s+"), cut)

    return F.flatten(F.transform(F.split(paragraph, r"(?<=[.!?;])\s+"), windows))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def training_texts(sample: list[str], seed: int = 9) -> list[tuple[str, tuple[str, ...]]]:
    """``(text, families)``: the templates whole, cut, joined in pairs, and put into sentences of the corpus."""
    rng, texts = np.random.default_rng(seed), [(t, ()) for t in sample]
    every = [(family, statement) for family, statements in TEMPLATES.items() for statement in statements]
    for family, statement in every:
        tokens = statement.split()
        texts += [(statement, (family,))] * 4
        for _ in range(8):
            n = int(rng.integers(min(len(tokens), max(3, round(0.7 * len(tokens)))), len(tokens) + 1))
            begin = int(rng.integers(0, len(tokens) - n + 1))
            around = (sample[int(rng.integers(len(sample)))] if sample else "").split()[:WINDOW_WORDS]
            cut = int(rng.integers(0, len(around) + 1))
            texts.append((" ".join(tokens[begin : begin + n]), (family,)))
            texts.append((" ".join([*around[:cut], *tokens, *around[cut:]]), (family,)))
        known = [(f, t) for f, t in every if f not in (family, UNKNOWN) and len(t.split()) <= 16]
        if family != UNKNOWN and len(tokens) <= 16:
            for _ in range(4):
                other, second = known[int(rng.integers(len(known)))]
                texts.append((f"{statement.rstrip('.')} {rng.choice(['and', 'or', 'and the', 'and under'])} {second}", (family, other)))
    return texts


def fit_on(docs: DataFrame, sample_paragraphs: int = SAMPLE_PARAGRAPHS, seed: int = 9) -> Model:
    """Fit on the templates and a sample of the sentences of ``(doc_id, text)``."""
    spark = docs.sparkSession
    some = docs.filter(F.octet_length("text") > 0).select("doc_id", F.col("text").cast("string").alias("text"))
    lines = some.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    part = excerpt(F.col("text"), F.col("doc_id"), seed)
    drawn = some.filter(draw < sample_paragraphs / max(1, lines)).limit(2 * sample_paragraphs).select(F.explode(F.split(part, "\n")).alias("t"))
    cut = drawn.filter("t <> ''").select(F.explode(sentences(F.col("t"))).alias("t"))
    sample = sorted(r["t"] for r in cut.filter("t <> ''").orderBy(F.xxhash64(F.lit(seed), "t")).limit(2 * sample_paragraphs).collect())
    texts = training_texts(sample, seed)
    given = [*texts, *((s, (f"={f}",)) for f, statements in TEMPLATES.items() for s in statements)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(given)], "i int, t string").select("i", ngrams(F.col("t")).alias("grams")).collect()
    grams = {r["i"]: set(r["grams"]) for r in rows}
    templates = [(y[0][1:], sorted(grams[i])) for i, (_, y) in enumerate(given) if y and y[0].startswith("=")]
    vocabulary = sorted(set().union(*[set(g) for _, g in templates]))
    place = {g: i for i, g in enumerate(vocabulary)}
    classes = list(TEMPLATES)
    known = [(family, set(g)) for family, g in templates if family != UNKNOWN]
    x, y = np.zeros((len(texts), len(vocabulary))), np.zeros((len(texts), len(classes)))
    plain = np.zeros(len(texts), bool)  # sentences of the corpus that say nothing of licences
    for i, (_, labels) in enumerate(texts):
        x[i, [place[g] for g in grams[i] if g in place]] = 1
        if i < len(sample):  # a sampled sentence may be a statement itself
            labels = {f for f, g in known if len(grams[i] & g) >= 2 and _similarity(grams[i], g) >= LEAST_SIMILARITY}
            plain[i] = not labels
        y[i, [classes.index(f) for f in labels]] = 1
    shares = x[plain].mean(axis=0) if plain.any() else np.zeros(len(vocabulary))
    telling = [g for g, share in zip(vocabulary, shares, strict=True) if share <= COMMON]
    x[:, shares > COMMON] = 0  # everyday words speak neither for nor against
    held = np.arange(len(texts)) % 4 == 3
    weights, bias = np.zeros((len(vocabulary), len(classes))), np.full(len(classes), -2.0)
    seen_w, seen_b = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    x_fit, target = x[~held], y[~held]
    for _ in range(200):
        error = (_sigmoid(x_fit @ weights + bias) - target) / len(target)
        gradient = x_fit.T @ error + 1e-5 * weights
        seen_w += gradient**2
        weights -= 0.3 * gradient / np.sqrt(seen_w)
        seen_b += error.sum(axis=0) ** 2
        bias -= 0.3 * error.sum(axis=0) / np.sqrt(seen_b)
    logits, told = x[held] @ weights + bias, y[held]

    def loss(t: float) -> float:
        p = _sigmoid(logits / t)
        return float(-(told * np.log(p + 1e-12) + (1 - told) * np.log(1 - p + 1e-12)).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    return Model(classes, vocabulary, weights.T / temperature, bias / temperature, templates, telling)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The sentences worth scoring, ``doc_id, paragraph, sentence, paragraph_text, n_grams, hits`` and the ``logits`` of all classes."""
    present = bytearray(1 << BITS)
    for h in model.telling:
        present[h & ((1 << BITS) - 1)] = 1
    table, telling, vocabulary = F.lit(bytes(present)), _longs(model.telling), _longs(model.vocabulary)

    def possible(h: Column) -> Column:
        return F.substring(table, h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")

    def looked_at(line: Column) -> Column:
        cut = F.transform(sentences(line), lambda t, i: F.struct(i.alias("sentence"), t.alias("text"), ngrams(t).alias("grams")))
        return F.filter(cut, lambda p: F.exists(p["grams"], possible))

    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line"), looked_at(line).alias("p")))
    lines = F.filter(lines, lambda x: F.size(x["p"]) > 0)
    rows = docs.select("doc_id", F.explode(lines).alias("x")).select("doc_id", "x.i", "x.line", F.explode("x.p").alias("p"))
    rows = rows.select(
        "doc_id", F.col("i").cast("bigint").alias("paragraph"), F.col("p.sentence").cast("bigint").alias("sentence"),
        F.col("line").alias("paragraph_text"), F.size("p.grams").alias("n_grams"), F.array_intersect("p.grams", vocabulary).alias("hits"),
    )
    rows = rows.filter(F.arrays_overlap("hits", telling))
    at = F.transform("hits", lambda h: (F.array_position(vocabulary, h) - 1).cast("int"))

    def logits(places: Column) -> Column:
        def logit(weights: np.ndarray, bias: float) -> Column:
            table = _doubles(weights)
            return F.aggregate(places, F.lit(float(bias)), lambda a, i: a + F.get(table, i))

        return F.array(*[logit(w, b) for w, b in zip(model.weights, model.bias, strict=True)])

    return rows.withColumn("logits", bound(at, logits))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """The sentences that are licence statements, a row for each family: ``doc_id, paragraph, sentence, family, probability, similarity,
    confirmed, paragraph_text``."""

    def similarity(template: list[int]) -> Column:
        return F.size(F.array_intersect("hits", _longs(template))) / F.least(F.col("n_grams"), F.lit(len(template)))

    def judged(k: int, family: str) -> Column:
        p = 1 / (1 + F.exp(-F.get("logits", F.lit(k))))
        alike = [similarity(g) for f, g in model.templates if f == family]
        return F.struct(F.lit(family).alias("family"), p.alias("p"), (F.greatest(*alike) if len(alike) > 1 else alike[0]).alias("similarity"))

    rows = scored(docs, model).filter(F.array_max("logits") >= float(np.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY))))
    rows = rows.withColumn("guesses", F.filter(F.array(*[judged(k, f) for k, f in enumerate(model.classes)]), lambda g: g["p"] >= LEAST_PROBABILITY))
    sure = F.filter("guesses", lambda g: (g["family"] != UNKNOWN) & (g["similarity"] >= LEAST_SIMILARITY))
    sure = F.transform(sure, lambda g: F.struct(g["family"].alias("family"), g["p"].alias("p"), g["similarity"].alias("similarity"), F.lit(True).alias("confirmed")))
    talk = F.filter("guesses", lambda g: g["similarity"] >= LEAST_UNKNOWN_SIMILARITY)
    best = F.array_max(F.transform(talk, lambda g: F.struct(g["p"].alias("p"), g["similarity"].alias("similarity"))))
    unknown = F.struct(F.lit(UNKNOWN).alias("family"), best["p"].alias("p"), best["similarity"].alias("similarity"), F.lit(False).alias("confirmed"))
    found = F.when(F.size(sure) > 0, sure).when(F.size(talk) > 0, F.array(unknown))
    return rows.select("doc_id", "paragraph", "sentence", "paragraph_text", F.explode(found).alias("f")).select(
        "doc_id", "paragraph", "sentence", "f.family", F.col("f.p").alias("probability"), "f.similarity", "f.confirmed", "paragraph_text"
    )
