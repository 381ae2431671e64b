"""Licence scan: a trained paragraph classifier, confirmed against templates. DataFrame operations only.

1. Features are word n-grams (one to three words) of the licence templates that contain a marker: a template word that
   is rare in ordinary paragraphs. A sparse (L1) multinomial logistic regression is trained on the templates, on
   versions of them with words left out, and on paragraphs of the corpus as the unknown class (a bounded sample, by
   hash). Its temperature and the least probability of a prediction are fitted on versions held out.
2. Scan: notices stand on one line or are wrapped over several, so a passage is a line, or neighbouring lines from one
   with a marker to another with one. A line without words (blank, or a bare comment sign) ends it, and between its
   first and last line lies no more than twice the longest template. Passages without a marker have no features, so
   their prediction is unknown whatever the weights; the others are cut into n-grams, across the ends of their lines,
   joined with the weights (a few thousand rows at most) and summed.
3. A predicted family is confirmed where enough of one of its templates' bigrams occur in the passage.
4. Of passages that share lines the best stays: confirmed, of the highest similarity, of the fewest lines.

Words are lower-case runs of letters, digits and dots. Defined results: null and empty texts have no passages; equal
passages of a document are reported each, by the number of their first line from 0; repeated rows give repeated
results; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

UNKNOWN = "unknown"

#: Notices and distinctive sentences of public licences, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla site.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) 2020 Example Corp. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}

WORD = "[^\\p{L}\\p{N}.]+"
_SPLIT = re.compile(r"[^\w.]+|_")


def words(text: str) -> list[str]:
    return [w for w in (w.strip(".") for w in _SPLIT.split(text.lower())) if w]


def grams(w: list[str], most: int = 3) -> set[str]:
    return {" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)}


def word_column(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), WORD), lambda w: F.regexp_replace(w, "^\\.+|\\.+$", "")), lambda w: w != "")


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]  # of each n-gram, by family; the unknown class is the zero
    bias: list[float]
    temperature: float
    least: float
    markers: list[str]


def versions(rng: random.Random, w: list[str]) -> list[str]:
    """A template with words left out, a year or version changed, or other words around it."""
    out = [x for x in w if rng.random() > 0.12] or list(w)
    out = [str(rng.randint(1, 9)) + ".0" if re.fullmatch(r"\d+(\.\d+)?", x) and rng.random() < 0.6 else x for x in out]
    noise = ["xx" + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 4))]
    return noise[: len(noise) // 2] + out + noise[len(noise) // 2 :]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample: int = 2_000, each: int = 24, l1: float = 2e-4, steps: int = 400) -> Model:
    """Fit on the templates and at most ``sample`` paragraphs of the corpus."""
    rows = docs.select(F.explode(F.split("text", "\n")).alias("p")).filter("length(p) > 0")
    share = docs.select(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0
    limit = min(1.0, 4.0 * sample / max(1, share))
    ordinary = [r["p"] for r in rows.filter(F.pmod(F.xxhash64("p"), F.lit(1_000_000)) < int(limit * 1_000_000)).orderBy(F.xxhash64("p"), "p").limit(sample).collect()]
    # a paragraph with two or more bigrams of the templates may be a licence itself: it teaches nothing about the others
    known = {g for ts in TEMPLATES.values() for t in ts for g in grams(words(t), 2) if " " in g}
    plain = [w for w in map(words, ordinary) if len(known & grams(w, 2)) < 2]
    seen: dict[str, int] = {}
    for w in plain:
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    families = list(TEMPLATES)
    template_words = {f: [words(t) for t in ts] for f, ts in TEMPLATES.items()}
    rare = max(2, len(plain) // 50)
    common = set("the of and to in is that it for was with as on are be this by at or from a an you may not if any all at which under either".split())
    markers = sorted({x for ts in template_words.values() for w in ts for x in w if len(x) > 1 and x not in common and not x.replace(".", "").isdigit() and seen.get(x, 0) <= max(rare, 0.02 * len(plain))})
    marked = set(markers)
    vocabulary = sorted({g for ts in template_words.values() for w in ts for g in grams(w) if marked & set(g.split(" "))})
    at = {g: i for i, g in enumerate(vocabulary)}
    rng = random.Random(7)
    data: list[tuple[list[str], int]] = []
    for k, f in enumerate(families):
        for w in template_words[f]:
            data += [(w, k)] + [(versions(rng, w), k) for _ in range(each)]
    # without a marker there are no features, so a few such paragraphs stand for all
    data += [(w, len(families)) for w in plain if not marked & set(w)][:200] + [(w, len(families)) for w in plain if marked & set(w)]
    data += [([m, "xx1"], len(families)) for m in markers for _ in range(3)]
    # words of several licences, in ordinary sentences, are no licence
    data += [([rng.choice(markers) for _ in range(rng.randint(1, 2))] + ["xx1"] * rng.randint(3, 12), len(families)) for _ in range(60 * len(families))]
    x = np.zeros((len(data), len(vocabulary)), dtype=np.float32)
    y = np.array([k for _, k in data])
    for i, (w, _) in enumerate(data):
        for g in grams(w):
            if g in at:
                x[i, at[g]] = 1
    x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
    held = np.array([rng.random() < 0.25 for _ in data])
    n = len(families) + 1
    target = np.eye(n)[y]
    weight = np.where(y == n - 1, 4.0, 1.0) / np.maximum(1, np.bincount(y, minlength=n))[y]
    weight = weight / weight[~held].sum()
    w, b = np.zeros((len(vocabulary), n)), np.zeros(n)
    b[-1] = 1.0
    rate = 40.0
    for _ in range(steps):  # proximal gradient
        p = softmax(x[~held] @ w + b)
        d = (p - target[~held]) * weight[~held, None]
        w -= rate * (x[~held].T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= 4.0 * d.sum(axis=0)
    logits = x[held] @ w + b
    temperature = min((t for t in np.geomspace(0.05, 4, 40)), key=lambda t: -np.log(softmax(logits / t)[np.arange(held.sum()), y[held]] + 1e-12).mean())
    p = softmax(logits / temperature)
    unknown = p[y[held] == n - 1]
    # at most one in a thousand of the held-out ordinary paragraphs may pass
    least = max(0.5, float(np.quantile(1 - unknown[:, -1], 0.999)) if len(unknown) else 0.5)
    kept = np.flatnonzero(np.abs(w).max(axis=1) > 1e-6)
    delta = w[:, :-1] - w[:, -1:]
    return Model(families, {vocabulary[i]: [float(v) for v in delta[i]] for i in kept.tolist()}, [float(v) for v in b[:-1] - b[-1]], float(temperature), min(0.9, least), markers)


def passages(docs: DataFrame, markers: list[str]) -> DataFrame:
    """(doc_id, row, line, last, p): lines with markers, and neighbouring lines from one with a marker to another."""
    longest = [t for ts in TEMPLATES.values() for t in ts]
    chars, reach = 2 * max(map(len, longest)), 2 * max(len(words(t)) for t in longest)
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", "\n").alias("lines"))
    # a marker occurs in the lower-case line wherever it is one of its words
    parts = F.array(*map(F.lit, sorted({x for m in markers for x in re.split(r"\W+", m) if x})))
    rows = rows.withColumn("marked", F.transform("lines", lambda p: F.arrays_overlap(F.split(F.lower(p), "[^\\p{L}\\p{N}]+"), parts)))

    def ends(s: Column) -> Column:
        """Lines with markers at which a passage from line ``s`` may end."""
        start = F.struct(F.lit(0).alias("inside"), F.lit(True).alias("open"), F.array().cast("array<int>").alias("ends"))

        def step(a: Column, i: Column) -> Column:
            p = F.get("lines", i)
            goes_on = a["open"] & (a["inside"] <= chars) & p.rlike("[\\p{L}\\p{N}]")
            return F.struct(
                (a["inside"] + F.when(i > s, F.length(p)).otherwise(0)).alias("inside"),
                goes_on.alias("open"),
                F.when(goes_on & F.get("marked", i), F.concat(a["ends"], F.array(i))).otherwise(a["ends"]).alias("ends"),
            )

        return F.aggregate(F.sequence(s, F.least(s + reach, F.size("lines") - 1)), start, step, lambda a: a["ends"])

    # line numbers of the marked lines; a text of one line or more has lines
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("marked", i))
    cut = F.flatten(F.transform(starts, lambda s: F.transform(ends(s), lambda e: F.struct(s.alias("line"), e.alias("last"), F.array_join(F.slice("lines", s + 1, e - s + 1), "\n").alias("p")))))
    # outer: else the optimizer would repeat the whole expression in a filter
    return rows.filter("lines is not null").select("doc_id", "row", F.explode_outer(cut).alias("x")).filter("x is not null").select("doc_id", "row", "x.*")


def scan(docs: DataFrame, model: Model, similar: float = 0.6) -> DataFrame:
    """(doc_id, line, family, probability, similarity, confirmed) of the passages that have a family."""
    spark: SparkSession = docs.sparkSession
    k = len(model.families)
    cut = passages(docs, model.markers).withColumn("w", word_column(F.col("p"))).withColumn("n", F.size("w"))
    cut = cut.withColumn("key", F.struct("row", "line", "last"))
    n_grams = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(i) for i in (1, 2, 3)]), lambda m: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: i + m - 1 <= F.col("n")), lambda i: F.concat_ws(" ", F.slice("w", i, m))))))
    table = spark.createDataFrame([(g, w) for g, w in model.weights.items()] or [("", [0.0] * k)], "gram string, weights array<double>")  # a few thousand rows
    # only n-grams with weights become rows (outer: else the optimizer would repeat the whole expression in a filter)
    used = sorted(model.weights) or [""]
    hits = cut.withColumn("grams", F.filter(n_grams, lambda g: g.isin(*used))).select("doc_id", "key", F.explode_outer("grams").alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy("doc_id", "key").agg(F.count("*").alias("m"), F.collect_set("gram").alias("grams"), *[F.sum(F.get("weights", i)).alias(f"s{i}") for i in range(k)])
    scores = F.array(*[(F.col(f"s{i}") / F.sqrt("m") + model.bias[i]) / model.temperature for i in range(k)])
    scored = sums.withColumn("z", scores).withColumn("best", F.array_max("z"))
    total = F.aggregate("z", F.exp(-F.col("best")), lambda a, z: a + F.exp(z - F.col("best")))  # the unknown class scores zero
    scored = scored.withColumn("probability", 1.0 / total).withColumn("at", F.array_position("z", F.col("best")).cast("int"))
    family = F.get(F.array(*map(F.lit, model.families)), F.col("at") - 1)
    found = scored.withColumn("family", family).filter(F.col("probability") >= model.least)
    # templates: the share of a template's bigrams (of the model's vocabulary) in the paragraph
    pairs = {f: [sorted({g for g in grams(words(t), 2) if " " in g and g in model.weights}) for t in ts] for f, ts in TEMPLATES.items()}
    best = F.lit(0.0)
    for f, ts in pairs.items():
        for t in ts:
            if t:
                share = F.size(F.array_intersect("grams", F.array(*map(F.lit, t)))) / F.lit(float(len(t)))
                best = F.greatest(best, F.when(F.col("family") == f, share).otherwise(0.0))
    rated = found.withColumn("similarity", F.round(best, 6)).withColumn("confirmed", best >= similar)
    # of a document's passages the best first, each that shares no line with one before it
    order = F.struct((~F.col("confirmed")).alias("open"), (-F.col("similarity")).alias("less"), (F.col("key.last") - F.col("key.line")).alias("more"), F.col("key.line").alias("line"), F.col("key.last").alias("last"),
                     "family", F.round("probability", 6).alias("probability"), "similarity", "confirmed")
    ranked = rated.groupBy("doc_id", "key.row").agg(F.sort_array(F.collect_list(order)).alias("ranked"))
    kept = F.aggregate("ranked", F.slice("ranked", 1, 0), lambda a, x: F.when(F.exists(a, lambda y: (y["line"] <= x["last"]) & (x["line"] <= y["last"])), a).otherwise(F.concat(a, F.array(x))))
    return ranked.select("doc_id", F.explode_outer(kept).alias("x")).select("doc_id", "x.line", "x.family", "x.probability", "x.similarity", "x.confirmed")


def licences(docs: DataFrame) -> DataFrame:
    """Train on a bounded sample and scan all of ``docs`` (doc_id, text)."""
    docs = pick(docs, doc_id="long", text="string")
    return scan(docs, train(docs))


