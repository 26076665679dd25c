"""Spelling variants against comparing all pairs, with every size of key groups."""

import random
import re
import zlib

import pytest

from scanweave.llm import variants


def edits(a, b):
    """Whether one letter inserted, deleted or replaced turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def reference(counted, ratio=10):
    near = {w: [v for v in counted if edits(w, v)] for w in counted}
    form = {}
    for w, n in counted.items():
        best = min(near[w], key=lambda v: (-counted[v], v), default=None)
        form[w] = best if best is not None and counted[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w], counted.get(form[w]), root(w)) for w, n in counted.items())


def vocabulary(seed, size, letters="abcÀÿ×"):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(size)}
    for w in sorted(words):
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(w))
            words.add(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]]))
    return {w: r.choice([1, 2, 3, 30, 31, 300, 4000]) for w in sorted(words - {""})}


def run(spark, counted, **kw):
    frame = spark.createDataFrame([(w, n, "x", "y") for w, n in counted.items()], "word string, n long, form string, key string")
    got = variants.spelling_variants(frame, **kw)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("most", [1, 6, 128])
def test_equals_all_pairs_however_often_keys_are_refined(spark, most):
    counted = vocabulary(3, 250)
    assert run(spark, counted, most=most) == reference(counted)


@pytest.mark.parametrize("most", [2, 64])
def test_a_hot_half_is_refined_without_losing_links(spark, most):
    r = random.Random(8)
    counted = {"counter" + "".join(r.choice("abcdefg") for _ in range(7)): r.choice([2, 50]) for _ in range(500)}
    counted |= {w[:9] + r.choice("xyz") + w[9:]: 700 for w in list(counted)[::5]} | {"q" * 40: 2, "q" * 41: 20, "q" * 2000: 3, "q" * 1000 + "r" + "q" * 1000: 40}
    assert run(spark, counted, most=most) == reference(counted)


def test_chains_of_forms_end_at_their_last(spark):
    counted = {"a" * (5 + k): 10**k for k in range(9)}
    got = run(spark, counted)
    assert got == reference(counted) and {r[5] for r in got} == {"a" * 13}


def test_empty_tables_nulls_and_ties(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.spelling_variants(empty).collect() == []
    some = spark.createDataFrame([("abcdefg", 1), ("abcdefh", 10), ("abcdefi", 10), (None, 99)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"]) for r in variants.spelling_variants(some).collect()}
    assert got == {"abcdefg": (2, "abcdefh"), "abcdefh": (2, None), "abcdefi": (2, None)}
    with pytest.raises(ValueError, match="more"):
        variants.spelling_variants(some, ratio=1)


def test_words_and_planted_misspellings(spark):
    rows = [(7, "Straßenbahn STRASSENBAHN naïveté×x short Élèvesss;élèvesss", "w"), (None, "another, another", "w"), (8, None, "w"), (9, "", "w"), (7, "another", "w")]
    rows += [(k, "another misspelling of Something", "w") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = {}
    for i, t, _ in rows:
        for run_ in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run_)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            if len(w) >= 7:
                want[w] = want.get(w, 0) + 1
    got = variants.counts(variants.thinned(variants.occurrences(docs)))
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if n >= 2}
