"""Fill-in-the-middle against a plain version by regular expressions, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scanweave.llm import infill

TEXTS = [
    None, "", "\n", "one line", "a\nb\n", "a\n\n\nb", "x <P> y\nz\n", "x <S>", "<M>", "<\nS>\n<P\n>", "ends in <S\n and <\n", "é漢😀\n\0\n é\n",
    "\r\n\r\n", "a" * 20_000 + "\n" + "b" * 9, "l\n" * 5_000,
]


def reference(doc_id, text, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, output string")


@pytest.mark.parametrize(("unit", "pattern"), [("lines", r"[^\n]*\n|[^\n]+"), ("words", r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+"), ("characters", "(?s).")])
def test_equals_the_plain_version_and_comes_back(spark, unit, pattern):
    r = random.Random(5)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "".join(r.choice("ab \n\t<S>PM") for _ in range(r.randint(0, 50)))) for k in range(150)]
    out = infill.transformed(docs_of(spark, rows), unit)
    got = {x["doc_id"]: tuple(x)[1:] for x in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()}
    assert got == {i: (*reference(i, t, pattern), t or "") for i, t in rows}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a\nb\nc\n"), (5, "a\nb\n"), (5, "a\nb\n"), (5, None)]
    out = infill.transformed(docs_of(spark, rows))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(i, *reference("" if i is None else i, t)) for i, t in rows], key=str)
    assert infill.transformed(docs_of(spark, rows).limit(0)).collect() == []
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_rates_and_own_sentinels(spark):
    rows = [(k, "one\ntwo\nthree\n") for k in range(400)]
    forms = [r["form"] for r in infill.transformed(docs_of(spark, rows), rate=30, spm_rate=0).collect()]
    assert set(forms) == {"plain", "psm"} and 80 < forms.count("psm") < 160
    own = ("<|pre|>", "<|suf|>", "<|mid|>")
    out = infill.transformed(docs_of(spark, rows), rate=100, sentinels=own)
    back = out.filter(infill.restored(F.col("output"), F.col("form"), own) != "one\ntwo\nthree\n")
    assert back.isEmpty() and {r["form"] for r in out.collect()} == {"psm", "spm"}


@pytest.mark.parametrize("sentinels", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "x", "y"), ("ab", "bc", "d"), ("abc", "b", "d")])
def test_sentinels_that_could_be_confused_are_refused(sentinels):
    with pytest.raises(ValueError):
        infill.checked(sentinels)
