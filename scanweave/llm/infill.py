"""Fill-in-the-middle: a text's middle moves behind its suffix, between sentinels.

A text is an array of code points. Neighbouring classes of characters tell
where its units, such as lines, begin; two ranks among these places, drawn from a
hash of the row's id, cut it into prefix, middle and suffix. The draw depends
on the seed and the id alone, so a task that runs again gives the same rows. Rows
are independent of one another, so nothing moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import texts

SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("lines", "words", "characters")
#: Code points that part words.
_BLANKS = np.array([9, 10, 11, 12, 13, 32], "<u4")
_OUT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def inner_boundaries(points: np.ndarray, unit: str = "lines") -> np.ndarray:
    """The places within a text where a unit begins: behind a line feed, at the first blank behind a word, or anywhere."""
    if unit == "characters":
        return np.arange(1, len(points))
    if unit == "lines":
        return np.flatnonzero(points[:-1] == 10) + 1
    blank = np.isin(points, _BLANKS)
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def draws(key: str) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def moved(text: str, key: str, unit: str, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of a text."""
    points = code_points(text)
    inner = inner_boundaries(points, unit) if text else points
    n = len(inner) + 1 if text else 0
    h1, h2, h3, h4 = draws(key)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    places = [0, *inner.tolist(), len(points)] if n < 64 else np.concatenate([[0], inner, [len(points)]])
    a, b = sorted((int(places[h1 % (n + 1)]), int(places[h2 % (n + 1)])))
    prefix, middle, suffix = _text(points[:a]), _text(points[a:b]), _text(points[b:])
    p, s, m = sentinels
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if a text's end and a sentinel can't make another: none holds another, and no start of one is the end of one."""
    for one in sentinels:
        for other in sentinels:
            overlaps = any(one.startswith(other[-k:]) for k in range(1, min(len(one), len(other)) + (one != other)))
            if not one or overlaps or (one != other and one in other):
                raise ValueError(f"the sentinels {one!r} and {other!r} can't be told apart")
    if len(set(sentinels)) != 3:
        raise ValueError("three different sentinels are needed")
    return sentinels


def transformed(
    docs: DataFrame,
    unit: str = "lines",
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = 7,
    sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row of ``docs``.

    ``n`` counts the units, ``rate`` and ``spm_rate`` are the percentages of texts that are
    moved at all and, of these, written suffix first. Form is ``plain`` (the text itself, no
    counts), ``psm`` or ``spm``. Plain are empty texts, those not drawn, and those
    that hold a sentinel. A null text is an empty one; a null id draws as an empty one; rows that
    repeat an id draw alike and each keep a row; an empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    tokens = checked(tuple(sentinels))

    @F.arrow_udf(_OUT_DDL)
    def out(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, own in columns:
            rows = (moved(t.as_py(), f"{seed}:{'' if i is None else i}", unit, rate, spm_rate, tokens) for i, t in zip(ids.to_pylist(), own, strict=True))
            yield pa.array([dict(zip(_OUT.names, r, strict=True)) for r in rows], _OUT)

    own = texts(docs, id_col, text_col)
    return own.select("doc_id", out("doc_id", "text").alias("out")).select("doc_id", "out.*")


_OUT_DDL = "n long, form string, prefix_chars long, middle_chars long, output string"


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transformed`` was given, from its output and form alone."""
    p, s, m = checked(tuple(sentinels))
    front, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(front, second, 1), F.lit(len(first) + 1)), F.substring_index(front, second, -1)

    prefix, suffix = parts(p, s)
    suffix_first, prefix_second = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_second, middle, suffix_first)).otherwise(output)


def digests(out: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``transformed`` with digests of the output and of the text rebuilt from it in its place."""
    back = restored(F.col("output"), F.col("form"), sentinels)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


#: DuckDB SQL for the digests of ``documents``, lines being the units.
ORACLE = r"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
drawn AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS two,
        ('0x' || h[25:32])::BIGINT % 100 AS h4, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM own),
cut AS (SELECT *, array_to_string(units[1:least(one, two)], '') AS prefix, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
        array_to_string(units[greatest(one, two) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
    sha256(CASE WHEN plain THEN text WHEN h4 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut"""
