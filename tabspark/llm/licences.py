"""Licence notices found by a trained paragraph classifier.

Training texts are windows of licence templates, by family, and paragraphs of the
corpus that share nothing with a template. A sparse logistic regression over word
n-grams tells the families and ``none`` apart. Below a confidence calibrated on
paragraphs held out from training, a notice is ``unknown``; above it, the predicted
family's templates are compared with the paragraph and must confirm it.

Everything runs as DataFrame expressions and Spark ML transformers in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm.common import id_hash, require, staged

# Wording that licence notices use.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the '
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Distributed under a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "creative commons": (
        "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
        "International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-nc-sa/4.0/",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "public domain": (
        "This is free and unencumbered software released into the public domain",
        "This work has been dedicated to the public domain under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved",
        "Copyright reserved by the author. All rights reserved. No part of this publication may be "
        "reproduced, distributed, or transmitted in any form or by any means without prior written "
        "permission",
        "This document is confidential and proprietary. Unauthorized copying is strictly prohibited",
    ),
}
NONE, UNKNOWN = "none", "unknown"
WINDOWS = (3, 4, 6, 9, 14, 22)


def words_of(text: Column) -> Column:
    """Lower-case words; letters, digits and inner dots."""
    cleaned = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])", " ")
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    last = F.size(words) - (n - 1)
    made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))


def features_of(words: Column) -> Column:
    return F.concat(words, grams(words, 2))


def shapes_of(words: Column) -> Column:
    """What is compared with templates: distinct word triples, the whole if shorter."""
    short = F.array(F.array_join(words, " "))
    return F.when(F.size(words) < 3, short).otherwise(F.array_distinct(grams(words, 3)))


@dataclass(frozen=True)
class LicenceModel:
    encoder: CountVectorizerModel
    classifier: LogisticRegressionModel
    labels: tuple[str, ...]
    threshold: float
    shapes: dict[str, tuple[tuple[str, ...], ...]]
    #: documents whose hash is below it were drawn for the fit
    share: int = 0


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string")


def once(df: DataFrame, *keep: str | Column, **made: Column) -> DataFrame:
    """``keep`` and new columns, each computed once per row.

    Plain projections are merged, and an array used within a lambda would then be
    made anew for each element; a generator is not merged.
    """
    row = F.struct(*[c.alias(name) for name, c in made.items()])
    return df.select(*keep, F.inline(F.array(row)))


def drawn(key: str, text: str, share: int) -> Column:
    """Whether a document belongs to the sample of the fit."""
    return F.pmod(id_hash(key, text), F.lit(2**32)) < share


def held_out() -> Column:
    """One paragraph in four, by its words; the fit has none of them."""
    return F.pmod(F.xxhash64("w"), F.lit(4)) == 0


def paragraphs(docs: DataFrame, key: str, text: str, share: int = 0) -> DataFrame:
    """(key, drawn, paragraph, w): the words of every line that has some, numbered from 0."""
    lines = docs.select(
        F.col(key).alias("key"), drawn(key, text, share).alias("drawn"),
        F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "text"),
    )
    return once(lines, "key", "drawn", "paragraph", w=words_of(F.col("text"))).where(F.size("w") > 0)


def clues(model: LicenceModel) -> list[str]:
    """Words of which a paragraph must hold one, or its likeliest class is ``none``.

    A term helps a family by at most its weight there less its weight in ``none``.
    Terms are left out, least helpful first, while all of them together could not
    make up for the advantage of ``none`` without any term.
    """
    weight = model.classifier.coefficientMatrix.toArray()
    bias = model.classifier.interceptVector.toArray()
    helps = (weight[1:] - weight[0]).max(axis=0)
    gap = float(bias[0] - bias[1:].max())
    terms = [(h, t) for h, t in sorted(zip(helps.tolist(), model.encoder.vocabulary)) if h > 0]
    out: dict[str, None] = {}
    single = {t: h for h, t in terms if " " not in t}
    for h, term in terms:
        gap -= h
        if gap < 0:
            # of a pair, the word that tells more
            out[max(term.split(" "), key=lambda w: (single.get(w, 0.0), len(w)))] = None
    return list(out)


def learn_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 1_000,
                   false_alarms: float = 0.002, vocabulary: int = 30_000) -> LicenceModel:
    """Fit on template windows and on the paragraphs of about ``sample_docs`` documents.

    The sample is drawn by a hash of the id, of the text without one; paragraphs that share three words in a
    row with a template stay out of it. One window or paragraph in four is held out:
    the confidence threshold is what all but ``false_alarms`` of the held-out plain
    paragraphs stay below, one half at least.
    """
    require(docs, [key, text])
    spark = docs.sparkSession
    known = once(template_table(spark), "family", w=words_of(F.col("text")))
    shapes: dict[str, list[tuple[str, ...]]] = {}
    for row in known.select("family", shapes_of(F.col("w")).alias("s")).collect():
        shapes.setdefault(row["family"], []).append(tuple(row["s"]))
    sizes = F.array(*[F.lit(n) for n in WINDOWS], F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    windows = (
        known.withColumn("n", F.explode(F.array_distinct(sizes))).where(F.col("n") <= F.size("w"))
        .withColumn("start", F.explode(starts))
        .select("family", F.slice("w", F.col("start"), F.col("n")).alias("w"))
        .distinct()
    )
    n = docs.count()
    share = min(2**32, int(2**32 * sample_docs / n)) if n else 0
    plain = (
        paragraphs(docs.where(drawn(key, text, share)), key, text)
        .where(~F.arrays_overlap(shapes_of(F.col("w")), _triples(shapes)))
        .select(F.lit(NONE).alias("family"), "w")
        .distinct()
    )
    labels = (NONE, *sorted(TEMPLATES))
    names = F.array(*[F.lit(x) for x in labels])
    rows = staged(
        windows.union(plain).select(
            (F.array_position(names, F.col("family")) - 1).cast("double").alias("label"),
            features_of(F.col("w")).alias("terms"),
            held_out().alias("held_out"),
            F.when(F.col("family") == NONE, 1.0).otherwise(4.0).alias("weight"),
        ),
        "licence_rows",
    )
    fit_rows = rows.where("NOT held_out")
    encoder = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=vocabulary, minDF=2, binary=True)
    encoder = encoder.fit(fit_rows)
    fit = LogisticRegression(weightCol="weight", regParam=2e-4, elasticNetParam=0.5, maxIter=20,
                             standardization=False)
    classifier = fit.fit(encoder.transform(fit_rows))
    classes = labels[: classifier.numClasses]
    scored = classifier.transform(encoder.transform(rows.where("held_out AND label = 0")))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(classes)))
    cut = scored.agg(F.percentile_approx(best, 1 - false_alarms, 10_000)).first()[0]
    return LicenceModel(encoder, classifier, classes, max(0.5, cut or 0.0),
                        {k: tuple(v) for k, v in shapes.items()}, share)


def _triples(shapes: Mapping[str, Sequence[Sequence[str]]]) -> Column:
    return F.array(*[F.lit(s) for t in shapes.values() for x in t for s in x])


def corpus_threshold(notices: DataFrame, docs: DataFrame, text: str, false_alarms: float) -> float:
    """The confidence that all but ``false_alarms`` of the plain paragraphs stay below; one half at least.

    Counted over the distinct lines of all documents. ``notices`` are the scored paragraphs whose
    likeliest class is a family; any other one is below one half anyway.
    """
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where("trim(line) <> ''")
    n = lines.agg(F.approx_count_distinct(F.xxhash64("line"), 0.01)).first()[0]
    plain = notices.where("_plain AND NOT _fitted").groupBy("_words").agg(F.max("probability").alias("best"))
    alarms, scored = int(false_alarms * n), plain.count()
    if scored <= alarms:
        return 0.5
    # half a rank below, so that rounding cannot reach the next one
    cut = plain.agg(F.percentile_approx("best", (scored - alarms - 0.5) / scored, 10_000)).first()[0]
    return max(0.5, cut)


def scan_licences(docs: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text",
                  confirm: float = 0.6, false_alarms: float | None = None) -> DataFrame:
    """(key, paragraph, licence, predicted, probability, similarity) of each notice.

    ``licence`` is the predicted family where the model is confident and the best
    template shares at least ``confirm`` of the smaller one's word triples, else
    ``unknown``. A paragraph is a line; it is listed if its likeliest class is a
    family. Texts that are null, empty or without a notice have no row; repeated
    rows and paragraphs are listed each. An empty table gives an empty result.
    The model's threshold comes from held-out paragraphs of its sample; with ``false_alarms``
    it comes from all paragraphs of ``docs`` that were not fitted, in the same pass that scores them.
    """
    require(docs, [key, text])
    found = paragraphs(docs, key, text, model.share)
    words = clues(model)
    bias = model.classifier.interceptVector.toArray()
    if bias[0] >= bias[1:].max():
        clue = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        found = found.where(F.arrays_overlap("w", clue))
    found = once(found, "key", "drawn", "paragraph", "w", terms=features_of(F.col("w")))
    scored = model.classifier.transform(model.encoder.transform(found)).where("prediction > 0")
    names = F.array(*[F.lit(x) for x in model.labels])
    predicted = F.element_at(names, F.col("prediction").cast("int") + 1)
    p = F.element_at(vector_to_array("probability"), F.col("prediction").cast("int") + 1)
    likeness = F.lit(None).cast("double")
    for family, templates in model.shapes.items():
        best = F.greatest(*[_overlap(F.col("shapes"), t) for t in (*templates, templates[0])])
        likeness = F.when(F.col("predicted") == family, best).otherwise(likeness)
    listed = once(
        scored, F.col("key").alias(key), "paragraph", F.xxhash64("w").alias("_words"),
        (F.col("drawn") & ~held_out()).alias("_fitted"),
        predicted=predicted, probability=p, shapes=shapes_of(F.col("w")),
    ).withColumn("similarity", likeness)
    threshold = model.threshold
    if false_alarms is not None:
        plain = ~F.arrays_overlap("shapes", _triples(model.shapes))
        listed = staged(listed.withColumn("_plain", plain).drop("shapes"), "licence_notices")
        threshold = corpus_threshold(listed, docs, text, false_alarms)
    sure = (F.col("probability") >= threshold) & (F.col("similarity") >= confirm)
    return listed.select(
        key, "paragraph", F.when(sure, F.col("predicted")).otherwise(UNKNOWN).alias("licence"),
        "predicted", "probability", "similarity",
    )


def _overlap(shapes: Column, template: tuple[str, ...]) -> Column:
    literal = F.array(*[F.lit(s) for s in template])
    return F.size(F.array_intersect(shapes, literal)) / F.least(F.size(shapes), F.lit(len(template)))
