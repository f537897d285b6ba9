"""Licence scans by a trained paragraph classifier.

A paragraph is a line, or several that were wrapped: a line that does not end a sentence goes on in the next one, without the marks
that comments in source files begin with, and a blank line ends it. Paragraphs that hold a licence word become sparse
word n-grams. A logistic regression over n-grams, trained here on notices of each family and on plain sentences, gives a
probability for each family and for an unknown class; its temperature is fitted on samples kept apart, and what is not
likely enough is unknown. A prediction is confirmed when the paragraph holds most n-grams of one of the family's
templates. Only the n-grams that hold a licence word are features, so a paragraph without such a word can only be
unknown, and the filter loses nothing; every licence word is a feature by itself, so no paragraph with one is lost.

The scan is DataFrame operations only; the weights (a fixed small table) are joined by n-gram.

Defined cases: a null or empty text has no paragraphs; paragraphs are numbered from 0 in each text, all of them; of families
or templates that do equally well the one named last in the order of their names (family), or first (template), is taken;
repeated rows are reported for each row; a text of one very long line is one paragraph; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.llm.common import table

#: Notices of each family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "This project is licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL version 3 or later.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Text is available under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "public-domain": ["This work has been released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission of the copyright holder."],
}
#: Ordinary sentences with the same words.
ORDINARY = [
    "He lost his driving licence last year.", "The bar applied for a license to sell drinks.", "A fishing license is needed for the lake.", "The doctor is licensed in two states.", "The public asked for the domain of the lord.",
    "She wrote the software in a week.", "The software was slow and the source of the river was far.", "Apache helicopters flew over the town.", "MIT professors gave a lecture.", "The creative director met the commons committee.",
    "The general public was not told.", "He gave his permission to use the garden.", "The version of the story was new.", "Copyright law is a hard subject.", "The copyright office is closed on Sunday.", "Mozilla had a party.",
    "License plates must be clean.", "Her poetic license went too far.", "The permission slip was granted to the class.", "Free of charge parking is behind the house.", "Human rights are reserved for no one.", "The foundation gave free books.",
    "The eclipse was seen by the public from the hill.", "The permission notice hung above the door.", "Her copyright claim was heard in court.", "The general manager granted permission to copy the notice.", "The gnu crossed the river with the herd.",
    "A license fee is due each year.", "He renewed his license at the office.", "The attribution of the painting is in doubt.", "The commons was used for grazing.", "Creative writing is taught on Monday.", "The seats are reserved for guests.",
    "The license terms were agreed with the vendor.", "See the license agreement of the vendor for terms.", "The warranty does not cover this software.", "Public transport is free on Sunday.", "The redistribution of land was slow.",
]
#: Words that make an n-gram a feature.
WORDS = (
    "license licenses licensed licence licences licensed apache bsd gpl lgpl gnu mpl mozilla cc cc0 creative commons attribution noncommercial sharealike copyright "
    "permission permitted redistribution redistribute reserved spdx domain software unencumbered isc eclipse epl agpl affero"
).split()
UNKNOWN = "unknown"


#: A line feed inside a paragraph, with the comment marks of the next line: the line does not end a sentence and the next has words.
WRAP = r"(?<![.!?;\s])[\x20\t\r]*\n[\x20\t]*(?:(?:[#*%;!>|]|//|--)+(?=[\x20\t]))?[\x20\t]*(?=[^\s#*%;!>|/-])"


def ngrams(text: str) -> set[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return {g for g in grams if not LICENCE.isdisjoint(g.split())}


LICENCE = frozenset(WORDS)


def samples(n: int = 160, seed: int = 3) -> list[tuple[str, str]]:
    """Labelled paragraphs made by rule: notices among ordinary words, with some of their words left out."""
    rnd = random.Random(seed)
    plain = " ".join(ORDINARY).lower().replace(".", "").split()
    out = []
    for family, notices in TEMPLATES.items():
        for i in range(n):
            words = [w for w in notices[i % len(notices)].split() if rnd.random() > 0.06]
            out.append((family, " ".join(rnd.choices(plain, k=rnd.randint(0, 12)) + words + rnd.choices(plain, k=rnd.randint(0, 12)))))
    for i in range(6 * n):
        out.append((UNKNOWN, ORDINARY[i % len(ORDINARY)] + " " + " ".join(rnd.choices(plain, k=rnd.randint(0, 20)))))
    return out


class Model:
    """Weights of n-grams by family, biases, temperature, and the n-grams of each template."""

    def __init__(self, labelled: list[tuple[str, str]], steps: int = 400, least_seen: int = 6):
        self.families = [*TEMPLATES, UNKNOWN]
        grams = [ngrams(t) for _, t in labelled]
        self.templates = [(f, i, ngrams(t)) for f, notices in TEMPLATES.items() for i, t in enumerate(notices)]
        seen = Counter(g for gs in grams for g in gs)
        self.vocabulary = sorted({g for g, n in seen.items() if n >= least_seen}.union(LICENCE, *(g for _, _, g in self.templates)))
        at = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(labelled), len(at)))
        for i, gs in enumerate(grams):
            x[i, [at[g] for g in gs if g in at]] = 1
        y = np.eye(len(self.families))[[self.families.index(f) for f, _ in labelled]]
        kept = np.arange(len(x)) // 16 % 4 == 0  # every notice is on both sides
        fit = ~kept
        # softmax regression by Adam; the bias is the last row
        x = np.hstack((x, np.ones((len(x), 1))))
        w = np.zeros((x.shape[1], y.shape[1]))
        m, v = 0 * w, 0 * w
        for t in range(1, steps + 1):
            g = x[fit].T @ (self._softmax(x[fit] @ w) - y[fit]) / fit.sum() + 1e-6 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.bias = w[:-1], w[-1]
        z = x[kept] @ w
        losses = {t: -np.log(self._softmax(z / t)[y[kept] == 1] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)}
        self.temperature = min(losses, key=losses.get)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@functools.cache
def trained() -> Model:
    return Model(samples())


def scan(docs: DataFrame, model: Model | None = None, least: float = 0.5, agree: float = 0.7) -> DataFrame:
    """(doc_id, paragraph, family, probability, template, similarity, confirmed) of each paragraph with a licence word."""
    model = model or trained()
    spark, n = docs.sparkSession, len(model.families)
    # a fixed table of a few thousand rows: n-gram, weights by family, templates that hold it
    holds = {g: [i for i, (_, _, t) in enumerate(model.templates) if g in t] for g in model.vocabulary}
    known = spark.createDataFrame([(g, [float(v) for v in w], holds[g]) for g, w in zip(model.vocabulary, model.weights)], "gram string, w array<double>, held array<int>")
    trigger = r"(?i)(?<![a-z0-9])(?:" + "|".join(w.replace(" ", "[^a-z0-9]+") for w in sorted(set(WORDS), key=lambda w: (-len(w), w))) + r")(?![a-z0-9])"
    lines = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").filter(F.col("text").rlike(trigger))
    whole = F.regexp_replace("text", WRAP, " ")
    lines = lines.select("rid", "doc_id", F.posexplode(F.split(whole, "\n")).alias("paragraph", "line")).filter(F.col("line").rlike(trigger))
    words = lines.withColumn("words", F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0)))
    grams = [F.expr(f"transform(if(size(words) >= {k}, sequence(1, size(words) - {k - 1}), array()), i -> array_join(slice(words, i, {k}), ' '))") for k in (1, 2, 3)]
    grams = words.select("rid", "doc_id", "paragraph", F.explode(F.array_distinct(F.concat(*grams))).alias("gram")).join(F.broadcast(known), "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)] + [F.sum(F.when(F.array_contains("held", i), 1).otherwise(0)).alias(f"t{i}") for i in range(len(model.templates))]
    by = grams.groupBy("rid", "doc_id", "paragraph").agg(*sums)
    by = by.withColumn("e", F.array(*[F.exp((F.col(f"z{i}") + float(model.bias[i])) / model.temperature) for i in range(n)]))
    by = by.withColumn("top", F.array_max(F.arrays_zip(F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"), F.array(*[F.lit(f) for f in model.families]).alias("f"))))
    sure = (F.col("top.p") >= least) & (F.col("top.f") != UNKNOWN)
    by = by.withColumn("family", F.when(sure, F.col("top.f")).otherwise(UNKNOWN)).withColumn("probability", F.col("top.p"))
    compared = F.array(*[F.struct((F.col(f"t{i}") / len(t)).alias("s"), F.lit(-k).alias("k"), F.lit(f).alias("f")) for i, (f, k, t) in enumerate(model.templates)])
    by = by.withColumn("best", F.array_max(F.filter(compared, lambda c: c["f"] == F.col("family"))))
    return by.select("doc_id", "paragraph", "family", "probability", (-F.col("best.k")).alias("template"), F.coalesce("best.s", F.lit(0.0)).alias("similarity"), (F.coalesce("best.s", F.lit(0.0)) >= agree).alias("confirmed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
