"""License notices that are in no template, hard cases among ordinary lines, wrapped and very long lines."""

import random

import pytest

from scanweave.llm import licenses

#: Notices of no template or frame, by family.
NEW = {
    "apache": ("The toolkit is offered under Apache License 2.0 terms.", "Apache-2.0 license terms apply to every file here."),
    "mit": ("You can use the code under the MIT license.", "Copyright (c) 2021 Ada Example. MIT License."),
    "gpl": ("licensed under the GNU GPL v3", "This package may be redistributed under GPL v2.", "The plugin is under the GNU General Public License, version 2."),
    "lgpl": ("The library can be linked under the LGPL v2.1.", "It is covered by the GNU Lesser General Public License."),
    "agpl": ("The server is under the GNU AGPL.", "All code here falls under the GNU Affero General Public License."),
    "bsd": ("These drivers are under the BSD 3-Clause License.", "Parts are licensed under a BSD license."),
    "mpl": ("Files in this folder are under the Mozilla Public License 2.0.",),
    "cc-by": ("Photos: Creative Commons Attribution 4.0", "The texts are shared under CC BY-SA 4.0."),
    "cc-by-nc": ("The figures are licensed CC BY-NC 4.0.",),
    "public-domain": ("The author has placed this in the public domain.", "Data are available under CC0 1.0."),
    "proprietary": ("Copyright 2019 Ada Example. All rights reserved.",),
    "unknown": (
        "Licensed under the Boost Software License 1.0.", "This program is released under the Eclipse Public License.", "Distributed under the ISC License.",
        "This code is licensed under the Blue Oak Model License.",
    ),
}
#: Ordinary lines with words of notices, none of them in the training lines.
PLAIN = (
    "My brother got his driving license in March.", "The public was asked to leave the building.", "General Mills sold the brand under another name.",
    "She gave permission for the photo.", "We reserved a table for six.", "The Apache pilots trained in the desert.", "In common with creative people he slept late.",
    "The terms of the loan were hard.", "The domain was sold for a million.", "A version of the story is in the library.", "The work was done by hand.",
    "Berkeley and MIT are old rivals.", "Software updates are free on Sundays.", "He distributed the bread among the poor.",
)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "ing", "ou", "re"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    ordinary = [(i, "\n".join(f"{prose(100 * i + j, 12)}." for j in range(8))) for i in range(60)]
    hard = [(100, "The license of the pub was not renewed.\nThe public library is open.\nReserved seats are in front.\nLicensed under the Apache License, Version 2.0.")]
    return licenses.fit(spark.createDataFrame(ordinary + hard, "doc_id long, text string"))


def found(spark, model, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan(df, model).collect()}


def test_new_notices_and_hard_lines(spark, model):
    """Recall and precision of 0.9 at least, of notices at all and of their families."""
    truth = [(line, f) for f, lines in NEW.items() for line in lines] + [(line, None) for line in PLAIN]
    got = found(spark, model, [line for line, _ in truth])
    named = {k: r["family"] if r["confirmed"] else "unknown" for k, r in got.items()}
    notices = {k for k, (_, f) in enumerate(truth) if f}
    right = {k for k in notices & set(named) if named[k] == truth[k][1]}
    wrong = [(truth[k], named.get(k)) for k in range(len(truth)) if named.get(k) != truth[k][1]]
    figures = len(notices & set(named)) / len(notices), len(notices & set(named)) / max(len(named), 1), len(right) / len(notices)
    print("recall, precision, share of right families", figures, wrong)
    assert figures[0] >= 0.9 and figures[1] >= 0.9 and figures[2] >= 0.85, (figures, wrong)
    assert all(0.0 < r["probability"] <= 1.0 for r in got.values())


def test_wrapped_and_long_lines(spark, model):
    """A wrapped notice is one paragraph; a notice at the far end of a very long line counts as any other."""
    wrapped = "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files\nNext sentence."
    got = licenses.scan(spark.createDataFrame([(1, wrapped)], "doc_id long, text string"), model).collect()
    assert [(r["place"], r["family"], r["confirmed"]) for r in got] == [(0, "mit", True)]
    tail = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    long = f"{prose(7, 3000)} {tail}"
    assert found(spark, model, [long])[0]["family"] == "mit"


def test_lines_without_helpful_words_cannot_pass(spark, model):
    """What the filter before scoring leaves out is below the threshold when it is scored."""
    helpful = model.helpful()
    assert helpful is not None
    every = licenses.LicenseModel(model.families, model.offsets, model.weights, model.slope, model.intercept)
    every.helpful = lambda: None
    lines = [line for ls in NEW.values() for line in ls] + list(PLAIN) + ["of the and", "to any"]
    df = spark.createDataFrame([(x,) for x in lines], "paragraph string")
    rows = [sorted((r["paragraph"], r["family"]) for r in licenses.scores(df, m).collect()) for m in (model, every)]
    assert rows[0] == rows[1]


def test_repeated_rows_and_null_ids(spark, model):
    notice = "Released under the MIT License."
    df = spark.createDataFrame([(1, notice), (1, notice), (1, "other"), (None, notice), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["place"]) for r in licenses.scan(df, model).collect())
    assert got == [(0, 0), (1, 0), (1, 0)]
