"""Licence scans: a trained paragraph classifier whose findings templates confirm."""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.llm.common import text_of

# Notices and key paragraphs of licences, as their authors publish them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("GPL", "Released under the GNU General Public License, version 2 or later."),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation"),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Licensed under the BSD 2-Clause License."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                  "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means "
                    "without the prior written permission of the publisher."),
]
# Words around a notice, and sentences that speak of licences without being one.
AROUND = [("", ""), ("This project is", ""), ("Note:", "See the file for details."), ("Copyright 2020 the authors.", ""),
          ("", "Some text follows here and goes on for a while."), ("The text of this page is", "as of today")]
UNRELATED = [
    "He lost his driving license on the way to the general store.",
    "The license plate of the car was new, and all rights of way were kept.",
    "The public was free to use the software at the library in the general area.",
    "MIT students met the Apache people of the region in version two of the play.",
    "She has permission to copy the work, but not to modify or distribute it yet.",
    "The terms and conditions of the sale are listed in the following section.",
    "In the event of any claim, the author of the book and the holder of the rights will speak.",
    "A creative person in the commons made an attribution of the work to the artist.",
    "Most of this is free, without any warranty of success, as far as we know.",
    "The source code was written in a form that is easy to read.",
]
UNKNOWN = "unknown"
STOP = set("the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they "
           "you were their one all we can her has there been if more when will would who so no any".split())
#: Rows the model is fitted on are bounded: the templates' variants and the paragraphs of this many documents at most.
SAMPLE_DOCUMENTS, SAMPLE_PARAGRAPHS = 600, 4000
#: Least 1 - P(unknown) of a finding. Fixed: what stands in a corpus never decides what counts as a licence in it.
THRESHOLD = 0.5
#: Least share of a template, or of a paragraph, that must agree for a finding to be confirmed.
CONFIRM = 0.6


def tokens(paragraph: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", paragraph.lower()) if w]


def grams(words: list[str]) -> list[str]:
    """Distinct words and pairs of neighbours, without lone function words."""
    return sorted({w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:])
                                                         if not (a in STOP and b in STOP)})


def word_column(paragraph: Column) -> Column:
    """:func:`tokens` of a text column."""
    return F.array_remove(F.split(F.lower(paragraph), "[^a-z0-9]+"), "")


def gram_column(words: Column) -> Column:
    """:func:`grams` of a column of words, in no order."""
    ones = F.array_except(words, F.array(*[F.lit(w) for w in sorted(STOP)]))
    stop = lambda w: w.isin(*sorted(STOP))
    pairs = F.filter(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)),
                                lambda a, b: F.when(~(stop(a) & stop(b)), F.concat_ws(" ", a, b))), lambda g: g.isNotNull())
    return F.array_distinct(F.concat(ones, pairs))


class Templates:
    """The grams of all templates, numbered, and which template has which."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        self.items = templates
        self.families = sorted({f for f, _ in templates})
        self.family_of = [self.families.index(f) for f, _ in templates]
        self.sets = [grams(tokens(t)) for _, t in templates]
        self.vocabulary = sorted({g for s in self.sets for g in s})
        self.number = {g: i for i, g in enumerate(self.vocabulary)}
        self.numbers = [sorted(self.number[g] for g in s) for s in self.sets]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g, i) for i, g in enumerate(self.vocabulary)], "gram string, number int")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, paragraph number, paragraph): the lines of a text; null is one empty line."""
    return docs.select(F.col(key).alias("id"), F.posexplode(F.split(text_of(text), "\n", -1)).alias("number", "paragraph"))


def found_grams(lines: DataFrame, templates: Templates) -> DataFrame:
    """(id, number, n_grams, found) of the paragraphs that hold any template gram; `found` are gram numbers.

    The table of grams is as large as the templates are, so it is broadcast; a paragraph
    meets in one row what its task has combined, an array no longer than that table.
    """
    table = templates.table(lines.sparkSession)
    own = F.array(*[F.lit(g) for g in templates.vocabulary if " " not in g])
    each = (lines.select("id", F.col("number").alias("paragraph_number"), word_column(F.col("paragraph")).alias("words"))
            .where(F.arrays_overlap("words", own))  # a pair of a template holds one of its words, too
            .select("id", "paragraph_number", gram_column(F.col("words")).alias("grams")))
    return (each.select("id", "paragraph_number", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
            .join(F.broadcast(table), "gram")
            .groupBy("id", "paragraph_number").agg(F.max("n_grams").alias("n_grams"), F.collect_set("number").alias("found")))


def constant(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


class Classifier:
    """Logistic regression over template grams, one class per family and one for all other text.

    `threshold` is what 1 - P(unknown) must reach, the same for every corpus.
    """

    def __init__(self, templates: Templates, weights: list[list[float]], bias: list[float], threshold: float):
        self.templates, self.weights, self.bias, self.threshold = templates, weights, bias, threshold

    def probabilities(self, found: Column) -> Column:
        """P of each class, the unknown one last."""
        table = constant(self.weights, "array<array<double>>")
        logits = F.aggregate(found, constant(self.bias, "array<double>"),
                             lambda s, i: F.zip_with(s, F.get(table, i), lambda a, b: a + b))
        top = F.transform(F.array(logits), lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z))))[0]
        return F.transform(F.array(top), lambda e: F.transform(
            e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Templates | None = None) -> Classifier:
    """Fit on variants of the templates against other text: sentences about licences, and paragraphs of
    the documents with the smallest MD5 of their key, as far as they are not like a template."""
    templates = templates or Templates()
    spark = docs.sparkSession
    known = len(templates.families)
    rows = [(float(known), grams(tokens(s))) for s in UNRELATED]
    for family, template in templates.items:
        label = float(templates.families.index(family))
        words = tokens(template)
        spans = [words[i:i + 12] for i in range(0, max(1, len(words) - 6), 4)] if len(words) > 16 else []
        for before, after in AROUND:
            rows.append((label, grams(tokens(before) + words + tokens(after))))
        rows += [(label, grams(s)) for s in spans]
    sampled = (docs.select(key).where(F.col(key).isNotNull()).distinct()
               .orderBy(F.md5(F.col(key).cast("string"))).limit(SAMPLE_DOCUMENTS))
    lines = (paragraphs(docs.join(F.broadcast(sampled), key, "left_semi"), key, text)
             .orderBy(F.md5(F.concat_ws(":", "id", "number")), "paragraph").limit(SAMPLE_PARAGRAPHS))  # no long text fills it
    others = found_grams(lines, templates)
    unlike = others.where(best_match(templates, F.col("found"), F.col("n_grams"))["similarity"] < 0.5).select("found").collect()
    sample = [(float(known), [templates.vocabulary[i] for i in sorted(r["found"])]) for r in unlike]
    sample.sort(key=lambda r: r[1])
    table = spark.createDataFrame(rows + sample, "label double, grams array<string>").coalesce(1)
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1,
                              vocabSize=len(templates.vocabulary) + 4096).fit(table)
    model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60).fit(counted.transform(table))
    at = {g: i for i, g in enumerate(counted.vocabulary)}
    matrix = model.coefficientMatrix.toArray()
    weights = [[round(float(matrix[c][at[g]]), 6) if g in at else 0.0 for c in range(known + 1)] for g in templates.vocabulary]
    return Classifier(templates, weights, [round(float(b), 6) for b in model.interceptVector.toArray()], THRESHOLD)


def best_match(templates: Templates, found: Column, n_grams: Column, family: Column | None = None) -> Column:
    """struct(similarity, template) of the template that agrees best: the larger of the share of its grams
    in the paragraph, and the share of the paragraph's grams that are its own if they are at least six.
    With `family` only templates of that family count."""
    sets, of = constant(templates.numbers, "array<array<int>>"), constant(templates.family_of, "array<int>")

    def match(i: Column) -> Column:
        both = F.size(F.array_intersect(found, F.get(sets, i)))
        share = F.greatest(both / F.size(F.get(sets, i)), F.when(both >= 6, both / n_grams).otherwise(0.0))
        return F.struct(F.when(F.get(of, i) == family, share).otherwise(-1.0).alias("similarity") if family is not None
                        else share.alias("similarity"), (-i).alias("order"), i.alias("template"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(templates.sets) - 1)), match))


def license_paragraphs(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, paragraph_number, family, confidence, similarity) of paragraphs with a confirmed licence."""
    templates = model.templates
    hits = found_grams(paragraphs(docs, key, text), templates).where(F.size("found") >= 2)
    scored = hits.withColumn("p", model.probabilities(F.col("found")))
    families = constant(templates.families, "array<string>")
    known = len(templates.families)
    named = (scored.withColumn("confidence", 1 - F.get("p", F.lit(known))).where(F.col("confidence") >= model.threshold)
             .withColumn("class", (F.array_position(F.slice("p", 1, known), F.array_max(F.slice("p", 1, known))) - 1).cast("int"))
             .withColumn("match", best_match(templates, F.col("found"), F.col("n_grams"), F.col("class"))))
    return named.where(F.col("match.similarity") >= CONFIRM).select(
        "id", "paragraph_number", F.get(families, F.col("class")).alias("family"), "confidence",
        F.col("match.similarity").alias("similarity"))


def license_scan(docs: DataFrame, model: Classifier | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: key, n_paragraphs, license (the family found with most confidence, `unknown` if none),
    licenses (all families, sorted, joined by a comma), n_license_paragraphs, first_paragraph, confidence, similarity.

    A paragraph is a line of the text; a null text is one empty line. The model, trained where
    none is given, names a family or none; a template of that family must agree. Rows that repeat a
    key are one document, and so are rows without a key. Other columns are not read. An empty table gives an empty result.
    """
    model = model or train(docs, key, text)
    found = license_paragraphs(docs, model, key, text)
    top = F.struct("confidence", "similarity", "family")
    by_row = found.groupBy("id").agg(
        F.max(top).alias("top"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licenses"),
        F.count(F.lit(1)).alias("n_license_paragraphs"), F.min("paragraph_number").alias("first_paragraph"))
    lines = F.size(F.split(text_of(text), "\n", -1)).cast("long")
    rows = docs.select(F.col(key).alias("row_id"), lines.alias("n_paragraphs"))
    return rows.join(by_row, F.col("row_id").eqNullSafe(F.col("id")), "left").select(
        F.col("row_id").alias(key), "n_paragraphs", F.coalesce("top.family", F.lit(UNKNOWN)).alias("license"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_license_paragraphs", F.lit(0)).cast("long").alias("n_license_paragraphs"), "first_paragraph",
        F.coalesce("top.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("top.similarity", F.lit(0.0)).alias("similarity"))
