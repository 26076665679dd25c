"""Quality classifier: importance resampling of documents.

Two generative models give the probability of a hashed n-gram: one of the
target text (documents labelled good), one of the raw text (every document).
A document's log weight is the sum of the log ratios of its n-grams, its key adds
standard Gumbel noise, and the documents with the k largest keys are the sample.
k is a share of the documents: an argument, or else an estimate of the good part
of the corpus from above. With f = min(1, e^weight) it adds up f over all documents,
corrects it by the mean of label less f over the labelled ones, and adds ``SPREAD``
standard errors of that mean.

The n-grams are unigrams and bigrams of words and punctuation, and bigrams and
trigrams of word shapes, in ``BUCKETS`` buckets. The raw counts cover all
documents. The target model uses at most ``target_rows`` labelled documents,
those with the least hash of their id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from scanweave.llm.common import col, texts, written

BUCKETS = 1 << 17
TARGET_ROWS = 50_000
SPREAD = 3.0
SEED = 7
PRIOR = 20.0
_TOKEN = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")
_DIGITS = re.compile(rb"\d")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    return ((x ^ (x >> np.uint64(29))) * _M2) >> np.uint64(40)


def _shape(token: bytes) -> int:
    """1 to 6 for digits, lower case, capitalised, capitals, mixed, other; from 16 on the punctuation itself."""
    if not (token[:1].isalnum() or token[0] >= 128 or token[0] == 95):
        return 16 + zlib.crc32(token)
    if token.islower():
        return 2
    if token[:1].isupper() and (len(token) == 1 or token[1:].islower()):
        return 3
    if token.isupper():
        return 4 if len(token) > 1 else 3
    if _DIGITS.search(token):
        return 1
    return 6 if token[0] >= 128 else 5


def ngram_buckets(text: bytes) -> np.ndarray:
    """The bucket of each n-gram of a UTF-8 text; none for a text without a token."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.empty(0, dtype=np.int64)
    n = len(tokens)
    shapes = np.fromiter(map(_shape, tokens), dtype=np.uint64, count=n)
    words = np.fromiter(map(zlib.crc32, text_lower(tokens)), dtype=np.uint64, count=n)
    shapes[1:][words[1:] == words[:-1]] = 7  # a token repeated
    one = _mixed(words + np.uint64(1))
    two = _mixed((words[:-1] * _M3 + words[1:]) ^ _M2)
    pairs = _mixed((shapes[:-1] * _M3 + shapes[1:]) ^ _M1)
    threes = _mixed(((shapes[:-2] * _M3 + shapes[1:-1]) * _M2 + shapes[2:]) ^ _M3)
    return (np.concatenate([one, two, pairs, threes]) % np.uint64(BUCKETS)).astype(np.int64)


def text_lower(tokens: list[bytes]) -> Iterator[bytes]:
    return map(bytes.lower, tokens)


def _counter(target: set[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = np.bincount(ngram_buckets(text), minlength=BUCKETS) if len(text) > 200_000 else None
                if found is not None:
                    sums[1] += found
                    if doc_id in target:
                        sums[0] += found
                else:
                    at, times = np.unique(ngram_buckets(text), return_counts=True)
                    sums[1][at] += times
                    if doc_id in target:
                        sums[0][at] += times
        used = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(sums[0][used]), pa.array(sums[1][used])],
            ["bucket", "target", "raw"],
        )

    return count


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> set[int]:
    """At most ``rows`` ids that every label calls good, those with the least hash."""
    good = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .filter("quality = 1")
    )
    least = good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)
    return {r.doc_id for r in least.select("doc_id").collect()}


def log_ratios(docs: DataFrame, target: set[int]) -> np.ndarray:
    """The log ratio of target to raw probability by bucket; ``docs(doc_id, text)``.

    Both are smoothed by ``PRIOR`` occurrences, so a bucket counts by how often the target rows
    would have been expected to show it, and rare ones hardly at all.
    """
    ids = docs.sparkSession.sparkContext.broadcast(target)

    def count(batches):
        yield from _counter(ids.value)(batches)

    sums = (
        docs.mapInArrow(count, "bucket int, target long, raw long")
        .groupBy("bucket")
        .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
        .toPandas()  # BUCKETS rows at most
    )
    both = np.zeros((2, BUCKETS))
    both[0][sums.bucket], both[1][sums.bucket] = sums.target, sums.raw
    if not both[0].sum():
        return np.zeros(BUCKETS)
    expected = both[1] * (both[0].sum() / both[1].sum())
    ratios = np.log(both[0] + PRIOR) - np.log(expected + PRIOR)
    return ratios - math.log((both[0] + PRIOR).sum() / (expected + PRIOR).sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__crc, __ngrams, __weight``, the sum of the log ratios; a null text is empty and an empty text weighs 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    place = docs.columns.index(text_col)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        for batch in batches:
            crcs, counts, found = [], [], []
            for text in batch.column(place).cast(pa.binary()).to_pylist():
                at = ngram_buckets(text or b"")
                crcs.append(zlib.crc32(text or b""))
                counts.append(len(at))
                found.append(float(by[at].sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(crcs, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.float64())],
                [*batch.schema.names, "__crc", "__ngrams", "__weight"],
            )

    new = [StructField("__crc", LongType()), StructField("__ngrams", LongType()), StructField("__weight", DoubleType())]
    return docs.mapInArrow(weigh, StructType([*docs.schema.fields, *new]))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024, exact_below: int = 20_000) -> float:
    """The k-th largest value of a double column, found by counting in ever narrower bins."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    left = rows.select(F.col(column).alias("v"))
    while True:
        width = (high - low) / bins
        if width <= 0:
            return low
        inside = left.filter((F.col("v") >= low) & (F.col("v") <= high))
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
        counts = {r["at"]: r["n"] for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                break
            k -= counts[b]
        inside = inside.filter(at == b)
        if counts[b] <= exact_below:
            return sorted((r.v for r in inside.collect()), reverse=True)[k - 1]
        new = inside.agg(F.min("v"), F.max("v")).first()
        if tuple(new) == (low, high):
            return low
        low, high = new


def good_share(weights: DataFrame, labels: DataFrame, spread: float = SPREAD) -> float:
    """The estimated share of good rows of ``weights(doc_id, __weight)`` plus ``spread`` standard errors; 1 without labels."""
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") != 0).cast("double").alias("good"))
    )
    guessed = weights.select("doc_id", F.exp(F.least("__weight", F.lit(0.0))).alias("f"))
    mean = guessed.agg(F.avg("f")).first()[0]
    n, off, sd = guessed.join(known, "doc_id").select((F.col("good") - F.col("f")).alias("e")).agg(F.count("*"), F.avg("e"), F.stddev("e")).first()
    return min(1.0, max(0.0, mean + off + spread * (sd or 0.0) / math.sqrt(n))) if n else 1.0


def _sampled(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, dropped: list[str], target_rows: int, share: float | None
) -> DataFrame:
    """The sampled rows of ``docs`` without the columns ``dropped``, with ``__crc, __ngrams, __weight, __key``."""
    target = target_ids(labels, target_rows)
    ratios = log_ratios(texts(docs, id_col, text_col), target)
    scored = written(log_weights(docs, ratios, text_col).drop(*dropped), "weights")
    if share is None:
        share = good_share(scored.select(col(id_col).cast("long").alias("doc_id"), "__weight"), labels)
    k = math.ceil(share * scored.count())
    u = (F.pmod(F.xxhash64(col(id_col).cast("long"), "__crc", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("__key", F.col("__weight") - F.log(-F.log(u)))
    return keyed.filter(F.col("__key") >= F.lit(kth_largest(keyed, "__key", k))) if k else keyed.limit(0)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_rows: int = TARGET_ROWS,
    share: float | None = None,
) -> DataFrame:
    """The sampled rows: ``doc_id, text_crc, n_ngrams, log_weight, gumbel_key``.

    Null texts are empty and weigh 0, as every text does without labelled target
    rows; without labels all rows are sampled; equal rows get equal keys and rows that tie with the k-th key all stay;
    a null doc_id is like any other value; an empty table gives an empty result;
    other columns are not read.
    """
    own = texts(docs, id_col, text_col)
    found = _sampled(own, labels, "doc_id", "text", ["text"], target_rows, share)
    return found.toDF("doc_id", "text_crc", "n_ngrams", "log_weight", "gumbel_key")


def sampled_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_rows: int = TARGET_ROWS,
    share: float | None = None,
) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns, which travel beside the weights rather than being joined again."""
    found = _sampled(docs, labels, id_col, text_col, [], target_rows, share)
    return found.select(*[col(c) for c in docs.columns])
