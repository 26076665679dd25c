"""License scans: a trained paragraph classifier over sparse word n-grams.

Paragraphs are lines, with wrapped ones joined again. A multinomial logistic
regression over unigrams and bigrams tells licence families from notices of
other licences, the unknown class, and both from ordinary text. It is fitted on
notices of each class, on names in usual frames, and on bounded samples of the
corpus' own whole paragraphs, those with words of notices among them.
How likely a paragraph is a notice at all is calibrated by a logistic curve on
held-out examples. A family is confirmed by comparing the paragraph's n-grams
with the family's notices and names; what no template confirms is unknown.

Everything is DataFrame expressions. Distinct paragraphs are classified once.
Only those with a word of some n-gram that speaks for a notice are scored,
because all others stay below the threshold whatever else they hold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm.common import texts, written

NONE, UNKNOWN = "none", "unknown"
#: Bounds of the fit: documents whose paragraphs are looked at, and paragraphs taken of them; as many more have words of notices.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 400, 2000
VOCABULARY = 4096
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.5
SEED = 5
#: Usual notices of each licence family, in public use.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL, version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is distributed under the terms of the Affero General Public License (AGPL).",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution license.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0. Not for commercial use.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "No part of this work may be reproduced without the prior written permission of the copyright holder.",
        "This document is proprietary and confidential; unauthorised copying is prohibited.",
    ),
}
#: Usual names of each family's licences.
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0 license", "Apache 2 license"),
    "mit": ("MIT License", "MIT/X11 License", "Expat License"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPL v2", "GPL v3", "GPLv3", "GNU GPL version 3 or later"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "LGPL v2.1", "LGPLv3", "GNU Library General Public License"),
    "agpl": ("GNU Affero General Public License", "GNU AGPL", "AGPL v3", "AGPLv3"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-2-Clause license", "new BSD License", "simplified BSD License"),
    "mpl": ("Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0"),
    "cc-by": ("CC BY 4.0", "CC BY-SA 3.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution-ShareAlike 3.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC-ND 3.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0"),
    "public-domain": ("CC0 1.0", "Creative Commons Zero", "the public domain", "the Unlicense"),
    UNKNOWN: (
        "Artistic License 2.0", "zlib License", "European Union Public Licence", "Microsoft Public License", "Academic Free License", "Open Software License",
        "Common Development and Distribution License", "PostgreSQL License", "Python Software Foundation License", "PHP License", "SIL Open Font License",
        "Open Data Commons License", "Community License Agreement", "Commons Clause License", "Sleepycat License", "Vim License", "Ruby License",
    ),
}
#: Frames in which such names stand.
FRAMES = (
    "Licensed under the {}.", "This project is licensed under the terms of the {}.", "Released under the {}.", "Distributed under the {}; see the file LICENSE.",
    "License: {}", "This software is made available under the {}", "The code is published under the {}.", "Use of this work is governed by the {}.",
    "{}", "This work is covered by the {}.",
)
#: Notices whose licence is of no listed family.
UNKNOWN_NOTICES = (
    "Licensed under the terms in the file LICENSE.",
    "See LICENSE for license information.",
    "Use of this source code is governed by a license that can be found in the LICENSE file.",
    "This file is distributed under the same license as the package.",
    "You may use, copy and modify this software under the terms of the license below.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "This license does not grant permission to use the trade names of the licensor.",
    "By downloading the software you accept the terms of this license agreement.",
)
#: Lines with words of notices that are not notices.
OTHERS = (
    "The driver lost his license after the accident.",
    "She works in the public library and is free on Sundays.",
    "A new version of the program was shown on television last night.",
    "All visitors are welcome and seats are reserved for members.",
    "The rights of the people were written in a document.",
    "He released the bird and it flew over the water.",
    "This work is hard and the terms are not good.",
    "The company will use the software in its offices.",
    "Version 3 of the map is on page 4.",
    "They asked permission to use a copy of the source.",
    "The general said that the public was free to go.",
    "A driving licence costs more than a fishing licence.",
    "The general public has a right to know the source of the water.",
    "Is a license needed to sell food at the market?",
    "The restaurant lost its liquor license last year.",
    "He asked the lesser known artist for a work on Mozilla and Apache helicopters.",
    "Creative people share what they have in common.",
    "Copyright law was discussed at the meeting of the city council.",
    "Students from MIT and Berkeley won the contest.",
    "All seats at the front are reserved.",
    "The table was reserved under the name of the general.",
    "Distribution of the leaflets began under heavy rain.",
    "The permission of the owner is not needed here.",
    "The domain of the function is open to the public.",
)
#: Words of notices; paragraphs with one of them are sampled besides, as the hard cases among ordinary text.
NOTICE_WORDS = ("licen", "copyright", "permission", "reserved", "public", "domain", "distribut", "creative", "terms", "apache", "mozilla")
#: A line end inside a sentence: no sentence ends before it, and the next line goes on in lower case, after marks of a comment.
_WRAP = r"(?<=[^\s.!?:;])[ \t]*\n[ \t]*(?:[#*/;%-]+[ \t]*)?(?=\p{Ll})"


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from literal values."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}]+|[0-9]+(?:\\.[0-9]+)*"), F.lit(0))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value worked out once, also where ``f`` names it inside a lambda."""
    return F.transform(F.array(value), f)[0]


def ngrams(tokens: Column) -> Column:
    """The unigrams and bigrams of an array of words, repeats included."""

    def both(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b)))

    return bound(tokens, both)


def paragraphs(own: DataFrame) -> DataFrame:
    """``doc_id, text_hash, place, paragraph`` of ``own(doc_id, text)``: lines that aren't blank, wrapped ones joined by a blank."""
    joined = F.regexp_replace("text", F.lit(_WRAP), F.lit(" "))
    lines = own.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(joined, "\n")).alias("place", "line"))
    return lines.select("doc_id", "text_hash", "place", F.trim("line").alias("paragraph")).filter("paragraph != ''")


def _examples(spark: SparkSession) -> DataFrame:
    """``family, paragraph, weight``: notices whole and, of long ones, both halves; names in frames; lines that are not notices."""
    rows = []
    for family, notices in {**TEMPLATES, UNKNOWN: UNKNOWN_NOTICES}.items():
        for notice in notices:
            parts = notice.split()
            rows += [{"family": family, "paragraph": notice, "weight": 4.0}]
            if len(parts) >= 12:
                for half in (parts[: len(parts) // 2 + 2], parts[len(parts) // 2 - 2 :]):
                    rows += [{"family": family, "paragraph": " ".join(half), "weight": 1.0}]
    rows += [{"family": f, "paragraph": frame.format(name), "weight": 1.0} for f, names in NAMES.items() for name in names for frame in FRAMES]
    rows += [{"family": NONE, "paragraph": p, "weight": 2.0} for p in OTHERS]
    return _rows(spark, rows, "family:string,paragraph:string,weight:double")


@dataclass
class LicenseModel:
    """Weights by n-gram less those of ordinary text, by class; and the curve that makes log odds of a notice a probability."""

    families: list[str]
    offsets: list[float]
    weights: dict[str, list[float]]
    slope: float
    intercept: float

    def helpful(self) -> list[str] | None:
        """Words of which a paragraph that passes must have one; None if it may pass without.

        N-grams of short, frequent words are left out as long as all of them together can't lift a paragraph to the threshold.
        """
        least = (math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY)) - self.intercept) / self.slope
        reach, kept = list(self.offsets), []
        if math.log(sum(map(math.exp, reach))) >= least:
            return None
        longest = lambda t: max(t.split(" "), key=len)
        for t in sorted((t for t, ws in self.weights.items() if max(ws) > 0), key=lambda t: (len(longest(t)), t)):
            lifted = [r + max(w, 0.0) for r, w in zip(reach, self.weights[t], strict=True)]
            if math.log(sum(map(math.exp, lifted))) < least:
                reach = lifted
            else:
                kept.append(longest(t))
        return sorted(set(kept))


def _sample(own: DataFrame) -> DataFrame:
    """``paragraph, weight`` of ordinary text: a bounded sample of whole paragraphs, and of those with words of notices.

    Those of the least hash are taken. Paragraphs with three fourths of the n-grams of a notice or name are left out: they may be notices.
    """
    ids = own.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE_DOCUMENTS).distinct()
    least = [F.xxhash64("paragraph"), "paragraph"]
    some = paragraphs(own.join(F.broadcast(ids), "doc_id", "left_semi")).select("paragraph").distinct().orderBy(*least).limit(SAMPLE_LINES)
    told = lambda name: bound(F.lower(name), lambda x: reduce(Column.__or__, [x.contains(w) for w in NOTICE_WORDS]))
    hard = paragraphs(own.filter(told("text"))).select("paragraph").filter(told("paragraph"))
    hard = hard.distinct().orderBy(*least).limit(SAMPLE_LINES)
    both = some.select("paragraph", F.lit(0.1).alias("weight")).unionByName(hard.select("paragraph", F.lit(0.3).alias("weight")))
    owns = F.from_json(F.lit(json.dumps([r["own"] for r in _templates(own.sparkSession).collect() if len(r["own"]) >= 3])), "array<array<string>>")
    terms = F.array_distinct(ngrams(words(F.col("paragraph"))))
    near = bound(terms, lambda t: F.exists(owns, lambda own: 4 * F.size(F.array_intersect(own, t)) >= 3 * F.size(own)))
    return both.filter(~near).groupBy("paragraph").agg(F.max("weight").alias("weight"))


def _curve(held: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from log odds ``z`` to the probability of ``label`` 1, fitted to smoothed labels."""
    counts = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    high, low = (counts.get(1.0, 0) + 1) / (counts.get(1.0, 0) + 2), 1 / (counts.get(0.0, 0) + 2)
    share = F.when(F.col("label") == 1, high).otherwise(low)
    both = F.array(F.struct(F.lit(1.0).alias("y"), share.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - share).alias("w")))
    rows = held.select(array_to_vector(F.array("z")).alias("features"), F.inline(both).alias("label", "w"))
    fitted = LogisticRegression(weightCol="w", maxIter=50).fit(rows)
    slope = float(fitted.coefficients[0])
    if slope <= 0:
        raise ValueError("the classifier ranks held-out notices no higher than other text")
    return slope, float(fitted.intercept)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """A model from notices, names in frames and bounded samples of the corpus' paragraphs.

    A fourth of all examples is held out from a first fit and calibrates it; the model
    itself is fitted on all of them.
    """
    own = texts(docs, id_col, text_col)
    spark = own.sparkSession
    sample = written(_sample(own), "sample").select(F.lit(NONE).alias("family"), "paragraph", "weight")
    order = [NONE, *TEMPLATES, UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, order)), F.col("family")).cast("double") - 1
    fold = F.pmod(F.xxhash64("paragraph", F.lit(SEED)), F.lit(4)).alias("fold")
    both = _examples(spark).unionByName(sample).coalesce(4)
    rows = both.select("family", "weight", fold, label.alias("label"), ngrams(words(F.col("paragraph"))).alias("terms"))
    vectors = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=VOCABULARY, minDF=1.0, binary=True)
    counted = vectors.fit(rows.filter(F.col("family") != NONE))
    vectored = written(counted.transform(rows).drop("terms"), "examples")
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0004, elasticNetParam=0.5, maxIter=60, standardization=False)
    none = vector_to_array("probability")[0]
    odds = F.log(F.greatest(1 - none, F.lit(1e-12)) / F.greatest(none, F.lit(1e-12)))
    held = model.fit(vectored.filter("fold != 0")).transform(vectored.filter("fold = 0"))
    slope, intercept = _curve(held.select(odds.alias("z"), F.when(F.col("family") == NONE, 0.0).otherwise(1.0).alias("label")))
    fitted = model.fit(vectored)
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = matrix[1:] - matrix[:1]
    by = {t: weights[:, k].tolist() for k, t in enumerate(counted.vocabulary) if weights[:, k].any()}
    return LicenseModel(order[1:], (intercepts[1:] - intercepts[0]).tolist(), by, slope, intercept)


def scores(distinct: DataFrame, model: LicenseModel) -> DataFrame:
    """``paragraph, terms, family, probability`` of those distinct paragraphs that are a notice with calibrated probability 0.5 or more.

    A class's score is its offset plus the weights of the n-grams present; without an n-gram
    of positive weight no class passes its offset. ``family`` is the class of the highest score
    (ties: the last name), ``probability`` that of a notice times the class's share among notices.
    """
    spark, helpful = distinct.sparkSession, model.helpful()
    terms = F.array_distinct(ngrams(F.col("words")))
    able = distinct.withColumn("words", words(F.col("paragraph")))
    if helpful is not None:
        able = able.filter(F.arrays_overlap("words", F.array(*map(F.lit, helpful))))
    exploded = able.select("paragraph", F.explode(terms).alias("term"))
    table = _rows(spark, [{"term": t, "w": ws} for t, ws in sorted(model.weights.items())], "term:string,w:array<double>")
    sums = exploded.join(F.broadcast(table), "term").groupBy("paragraph").agg(
        *[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(model.families))]
    )
    logits = F.array(*[F.col(f"s{k}") + F.lit(b) for k, b in enumerate(model.offsets)])
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda t, v: t + F.exp(v - F.col("top")))
    rank = F.zip_with("logits", F.lit(model.families), lambda v, f: F.struct(v.alias("logit"), f.alias("family")))
    best = F.array_max(rank)["family"]
    notice = 1 / (1 + F.exp(-(model.slope * (F.col("top") + F.log("total")) + model.intercept)))
    rated = sums.select("paragraph", logits.alias("logits")).withColumn("top", top).withColumn("total", total).withColumn("notice", notice)
    passed = rated.filter(F.col("notice") >= LEAST_PROBABILITY)
    return passed.select("paragraph", best.alias("family"), (F.col("notice") / F.col("total")).alias("probability")).withColumn(
        "terms", F.array_distinct(ngrams(words(F.col("paragraph"))))
    )


def _templates(spark: SparkSession) -> DataFrame:
    """``family, own``: the n-grams of each notice and name of the families."""
    rows = [{"family": f, "notice": n} for f, notices in TEMPLATES.items() for n in (*notices, *NAMES.get(f, ()))]
    return _rows(spark, rows, "family:string,notice:string").select("family", F.array_distinct(ngrams(words(F.col("notice")))).alias("own"))


def confirmed(found: DataFrame) -> DataFrame:
    """``found`` with ``similarity``, the best share of n-grams in common with a notice or name of the family, and ``confirmed``.

    The share is that of the smaller side, which counts for three n-grams at least. Notices of the unknown class have none.
    """
    by = _templates(found.sparkSession).groupBy("family").agg(F.collect_list("own").alias("owns"))
    smaller = lambda own, t: F.greatest(F.least(F.size(own), F.size(t)), F.lit(3))
    share = bound(F.col("terms"), lambda t: F.transform("owns", lambda own: F.size(F.array_intersect(own, t)) / smaller(own, t)))
    joined = found.join(F.broadcast(by), "family", "left").withColumn("similarity", F.coalesce(F.array_max(share), F.lit(0.0)))
    return joined.withColumn("confirmed", F.col("similarity") >= LEAST_SIMILARITY).drop("owns", "terms")


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, place, paragraph, family, probability, similarity, confirmed`` for each paragraph classified as a notice.

    Null and empty texts have no paragraphs; equal rows each give their notices, rows of
    one doc_id being told apart by 64 bits of their text's hash; a null doc_id is carried
    along; an empty table gives an empty result; other columns are not read. Paragraphs
    are whole however long they are.
    """
    lines = paragraphs(texts(docs, id_col, text_col))
    distinct = lines.select("paragraph").distinct()
    found = written(confirmed(scores(distinct, model)), "notices")
    return lines.join(found, "paragraph")


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_notices, families, family, probability, similarity``.

    ``families`` lists the confirmed families in order, ``family`` is that of the most
    probable confirmed notice; documents without one have ``none`` and zeros, and
    notices that no template confirms count as ``unknown``.
    """
    own = texts(docs, id_col, text_col)
    found = scan(docs, fit(docs, id_col, text_col), id_col, text_col)
    named = F.when(F.col("confirmed"), F.col("family")).otherwise(UNKNOWN)
    best = F.max(F.struct("confirmed", "probability", "similarity", "family"))
    by = found.withColumn("named", named).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.countDistinct("place").alias("n_notices"), F.array_sort(F.collect_set("named")).alias("families"), best.alias("best")
    )
    keys = own.select("doc_id", F.xxhash64("text").alias("hash"))
    joined = keys.join(by, keys.doc_id.eqNullSafe(F.col("__id")) & (keys.hash == F.col("__hash")), "left")
    family = F.when(F.col("best.confirmed"), F.col("best.family")).when(F.col("best").isNotNull(), F.lit(UNKNOWN)).otherwise(NONE)
    return joined.select(
        "doc_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"), family.alias("family"),
        F.round(F.coalesce("best.probability", F.lit(0.0)), 4).alias("probability"), F.round(F.coalesce("best.similarity", F.lit(0.0)), 4).alias("similarity"),
    )
