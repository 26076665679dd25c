"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon, its terms near second-person words,
capitals, punctuation and obfuscation. The lexicon is learned: words and word
beginnings whose document frequency differs most between toxic and other
training documents, so that inflected and invented forms count too. To keep
its weights honest, each half of the training rows gets features from the
lexicon of the other half; scoring uses the lexicon of both.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import texts, written

TRAIN_ROWS = 60_000
LEXICON_TERMS = 8192
MIN_DOCUMENTS, MIN_LOG_ODDS = 4, 1.5
STEMS = (4, 5, 6, 7, 8)
NEAR = 3
TREES, DEPTH, SEED = 30, 4, 11
THRESHOLD = 0.3
#: Second-person words of the corpus' languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
#: What is read as a letter inside a word.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
_TOKEN = re.compile(r"[^\W_]+(?:[@$*!.\-_]?[^\W_]+)*[@$*!]*|[^\w\s]+")
_ODD = re.compile(r"[0-9@$*!.\-_]")
_REPEAT = re.compile(r"(\w)\1{2,}")
NAMES = (
    "log_tokens", "lexicon_density", "lexicon_hits", "lexicon_max", "second_max", "strong_hits", "second_person_near", "second_person_rate",
    "capitals", "shouted_words", "punctuation", "marks", "obfuscated", "repeated_letters", "mean_word",
)


def plain(token: str) -> str:
    """A token in lower case with obfuscating signs read as letters."""
    if token.isalpha():
        return token.lower()
    core = token.rstrip("!")
    return "".join(c for c in core.translate(LEET) if c.isalpha()).lower() if core and not core.isdigit() else ""


def terms(text: str) -> set[str]:
    """The words of a text and, marked by a star, their beginnings."""
    words = {plain(t) for t in set(_TOKEN.findall(text))}
    words.discard("")
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _weight(word: str, lexicon: dict[str, float]) -> float:
    best = lexicon.get(word, 0.0)
    for n in STEMS:
        if len(word) > n:
            best = max(best, lexicon.get(f"{word[:n]}*", 0.0))
    return best


def features(text: str, lexicon: dict[str, float], cache: dict[str, float]) -> list[float]:
    """The values of ``NAMES`` for one text; ``cache`` keeps the weights of tokens already seen."""
    tokens = _TOKEN.findall(text)
    n = max(1, len(tokens))
    weights = []
    for t in tokens:
        w = cache.get(t)
        if w is None:
            p = plain(t)
            w = cache[t] = -1.0 if p in SECOND_PERSON else _weight(p, lexicon)
        weights.append(w)
    all_weights = np.array(weights or [0.0])
    hits = np.flatnonzero(all_weights > 0)
    found = np.sort(all_weights[hits])[::-1]
    seconds = np.flatnonzero(all_weights < 0)
    near = 0
    if len(hits) and len(seconds):
        at = np.searchsorted(seconds, hits)
        after = seconds[np.minimum(at, len(seconds) - 1)]
        before = seconds[np.maximum(at - 1, 0)]
        near = int(np.minimum(np.abs(after - hits), np.abs(before - hits)).__le__(NEAR).sum())
    odd = sum(1 for t in tokens if not t.isalpha() and len(t) > 2 and t[0].isalnum() and _ODD.search(t[:-1]) and not t.isdigit())
    letters = sum(map(len, tokens))
    upper = sum(k * sum(map(str.isupper, t)) for t, k in Counter(tokens).items())
    return [
        math.log1p(len(tokens)), float(found.sum()) / n, math.log1p(len(hits)), float(found[0]) if len(found) else 0.0,
        float(found[1]) if len(found) > 1 else 0.0, float((found > 3).sum()), near / n, len(seconds) / n,
        upper / max(1, letters), sum(1 for t in tokens if len(t) > 1 and t.isupper()) / n,
        sum(1 for t in tokens if not t[0].isalnum()) / n, text.count("!") / max(1, len(text)), odd / n,
        len(_REPEAT.findall(text)) / n, letters / n,
    ]


def _featured(docs: DataFrame, lexicons: list[dict[str, float]], which: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the text and with ``values``, from the lexicon whose number the column ``which`` has."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches: list[dict[str, float]] = [{} for _ in shared.value]
        for batch in batches:
            for cache in caches:
                if len(cache) > 300_000:
                    cache.clear()
            rows = zip(batch.column("text").to_pylist(), batch.column(which).to_pylist(), strict=True)
            values = [features(t, shared.value[k], caches[k]) for t, k in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(values, pa.list_(pa.float64()))], [*(f.name for f in rest), "values"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.mapInArrow(run, f"{fields}, values array<double>")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, for each term the toxic and other documents of either half that have it."""
    seen: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = list(zip(*seen.values(), strict=True)) or [[]] * 4
        names = ["term", "a0", "a1", "b0", "b1"]
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names)

    for batch in batches:
        for text, half, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "half", "toxic")), strict=True):
            for term in terms(text):
                seen.setdefault(term, [0, 0, 0, 0])[2 * half + toxic] += 1
        if len(seen) > 500_000:
            yield out()
            seen.clear()
    yield out()


def _lexicons(train: DataFrame, sizes: dict[tuple[int, int], int]) -> list[dict[str, float]]:
    """The lexicons of half 0, half 1 and both; each has ``LEXICON_TERMS`` terms at most."""
    sums = train.mapInArrow(_term_counts, "term string, a0 long, a1 long, b0 long, b1 long").groupBy("term").agg(
        *[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")]
    )
    sums = written(sums.filter(f"a1 + b1 >= {MIN_DOCUMENTS} AND a1 + b1 > 0"), "terms")
    out = []
    for other, toxic, halves in (("a0", "a1", (0,)), ("b0", "b1", (1,)), ("a0 + b0", "a1 + b1", (0, 1))):
        n0, n1 = (sum(sizes.get((h, y), 0) for h in halves) for y in (0, 1))
        odds = F.log((F.expr(toxic) + 0.5) / (n1 + 1.0)) - F.log((F.expr(other) + 0.5) / (n0 + 1.0))
        least = MIN_DOCUMENTS if len(halves) == 2 else max(2, MIN_DOCUMENTS // 2)
        best = (
            sums.filter(F.expr(toxic) >= least).select("term", odds.alias("odds")).filter(F.col("odds") >= MIN_LOG_ODDS)
            .orderBy(F.desc("odds"), "term").limit(LEXICON_TERMS)
        )
        out.append({r.term: float(r.odds) for r in best.collect()})
    return out


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int | None, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, toxic, half, text`` of at most ``rows`` labelled ids, those with the least hash.

    Ids whose CRC-32 of their text leaves ``held_out`` modulo 4 are not learned from. An id
    that any label calls toxic is toxic. The ids are broadcast, which ``rows`` bounds.
    """
    ids = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    if held_out is not None:
        ids = ids.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != held_out)
    known = ids.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)
    half = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)).cast("int")
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", half.alias("half"), "text")


def _one_row_each(train: DataFrame) -> DataFrame:
    """The table ``train`` with the text of least hash of each id, if ids repeat."""
    if train.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return train
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return written(train.groupBy("doc_id", "toxic", "half").agg(least), "training", train)


class ToxicityModel:
    """Trees, calibration and lexicon; ``score`` applies them to documents."""

    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None, curve: IsotonicRegressionModel | None, base: float):
        self.lexicon, self.trees, self.curve, self.base = lexicon, trees, curve, base

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, score, predicted`` for each row; null texts are empty, equal texts score alike.

        A model fitted without both classes scores every text with the share of toxic rows.
        """
        own = texts(docs, id_col, text_col)
        if self.trees is None:
            score = F.lit(self.base)
            rows = own.select("doc_id")
        else:
            rows = _featured(own.withColumn("which", F.lit(0)), [self.lexicon], "which")
            rows = self.trees.transform(rows.withColumn("features", array_to_vector("values")))
            rows = self.curve.transform(rows.withColumn("p", vector_to_array("probability")[1])).select("doc_id", "p", "calibrated")
            # the trees' own probability only orders what the calibration's steps tie
            score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("calibrated") + 0.001 * F.col("p")))
        scored = rows.select("doc_id", score.alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit(
    docs: DataFrame, labels: DataFrame, held_out: int | None = 2, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS
) -> ToxicityModel:
    """A model of ``labels(doc_id, toxic)`` on ``docs``; only texts are inputs.

    Labels without a document and null labels are not used; of several texts of an id
    the one of least hash is; an empty or one-sided training set gives a constant model.
    """
    train = _one_row_each(written(training_rows(texts(docs, id_col, text_col), labels, held_out, rows), "training"))
    sizes = {(r["half"], r["toxic"]): r["n"] for r in train.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    by_class = [sum(n for (_, y), n in sizes.items() if y == k) for k in (0, 1)]
    base = by_class[1] / max(1, sum(by_class))
    if not all(by_class):
        return ToxicityModel({}, None, None, base)
    lexicons = _lexicons(train, sizes)
    rows_ = _featured(train.withColumn("which", 1 - F.col("half")), lexicons, "which")
    featured = written(rows_.withColumn("label", F.col("toxic").cast("double")), "features").withColumn(
        "features", array_to_vector("values")
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 2)), F.lit(4))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=SEED, maxMemoryInMB=64).fit(featured.filter(fold != 0))
    calibration = trees.transform(featured.filter(fold == 0)).withColumn("p", vector_to_array("probability")[1])
    if calibration.select("label").distinct().count() < 2:
        calibration = trees.transform(featured).withColumn("p", vector_to_array("probability")[1])
    # equal probabilities are one weighted point, or all their rows would meet in one task
    points = calibration.groupBy("p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    curve = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(points)
    return ToxicityModel(lexicons[2], trees, curve, base)
