"""Benchmark decontamination by spaced seeds.

A mask such as 1101011 keeps some positions of a run of tokens and ignores the
others, so a run still hashes alike if ignored tokens were substituted. Of the masks for an item's
length one keeps clear of the differing tokens, whichever they are, so no overlap is missed. The
hashes of all benchmark runs under each mask make a seed table. A training
document's hashes pass a Bloom filter of the seed table, whose size is fixed
whatever the benchmark's, the few that remain join the table exactly, and the
tokens around each joined hit are compared place by place: a document is
contaminated by an item if ``WINDOW`` aligned tokens around a seed, or the whole
item if it is shorter, agree in at least ``SIMILARITY`` of the places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import col, dealt_join, texts, written

#: A run of ``WINDOW`` tokens of which two differ has five equal ones in a row or keeps the second mask's places;
#: the next two do the same for items of 3 to 12 tokens, the last two for shorter ones.
MASKS = ("11111", "1101011", "111", "1101", "11", "1")
WINDOW = 13
SIMILARITY = 0.8
BLOOM_BITS = 1 << 26
PROBES = 3
_WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")
_SQL_WORD = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPAN = max(map(len, MASKS))
#: Tokens before and after a hit's first token that travel with it.
BEFORE, AFTER = WINDOW - 1, _SPAN + WINDOW - 1
_HIT = "doc_id long, mask int, hash long, place int, around array<long>, size int"


def masks_of(size: int) -> tuple[int, ...]:
    """The numbers of the masks under which an item of ``size`` tokens is found, whichever tokens differ."""
    return (0, 1) if size >= WINDOW else (2, 3) if size > 2 else (4,) if size == 2 else (5,)


def token_hashes(text: str) -> list[int]:
    """Unsigned hashes of the lower-case words of a text; none is zero."""
    return [h or 1 for h in map(xxhash.xxh64_intdigest, _WORD.findall(text.lower().encode()), repeat(0))]


def masked_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each run of ``len(mask)`` tokens, over the places that the mask keeps."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    sums = np.full(n, len(mask), dtype=np.uint64)
    for at, keep in enumerate(mask):
        if keep == "1":
            sums = (sums ^ tokens[at : at + n]) * _ODD
            sums ^= sums >> np.uint64(31)
    return sums


def probes(hashes: np.ndarray) -> list[np.ndarray]:
    """The ``PROBES`` bits of the filter for each hash."""
    return [((hashes * np.uint64(2 * k + 1)) >> np.uint64(38 - 5 * k)) & np.uint64(BLOOM_BITS - 1) for k in range(PROBES)]


def _hits(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None, masks: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows ``_HIT`` of the runs under ``masks`` that pass the filter; without one, those of items under their own masks."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        lists = list(map(token_hashes, batch.column(1).to_pylist()))
        sizes = np.array(list(map(len, lists)), dtype=np.int64)
        ends = np.cumsum(sizes)
        tokens = np.fromiter((h for own in lists for h in own), dtype=np.uint64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(lists)), sizes)
        out: list[tuple] = []
        for m in masks:
            mask = MASKS[m]
            hashes = masked_hashes(tokens, mask)
            n = len(hashes)
            ok = owner[:n] == owner[len(mask) - 1 : len(mask) - 1 + n]
            if bits is None:
                ok &= np.array([m in masks_of(n) for n in sizes.tolist()], dtype=bool)[owner[:n]]
            else:
                for probe in probes(hashes):
                    ok &= (bits[probe >> np.uint64(3)] >> (probe & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            for at in np.flatnonzero(ok).tolist():
                d = int(owner[at])
                start = int(ends[d] - sizes[d])
                around = np.zeros(BEFORE + AFTER, dtype=np.uint64)
                low, high = max(start, at - BEFORE), min(int(ends[d]), at + AFTER)
                around[low - at + BEFORE : high - at + BEFORE] = tokens[low:high]
                out.append((ids[d], m, int(hashes[at].view(np.int64)), at - start, around.view(np.int64), int(sizes[d])))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["doc_id", "mask", "hash", "place", "around", "size"],
        )


def _bloom(seeds: DataFrame) -> np.ndarray:
    """The filter's bits; each task makes a part of the words that its hashes touch, and equal words are or-ed."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            bit = np.concatenate(probes(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((bit >> 3).astype(np.int32)), pa.array((1 << (bit & 7)).astype(np.int32))], ["at", "bits"]
            )

    set_words = seeds.select("hash").mapInArrow(words, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(BLOOM_BITS >> 3, dtype=np.uint8)
    bits[set_words["at"].to_numpy(dtype=np.int64)] = set_words["bits"].to_numpy(dtype=np.uint8)
    return bits


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_equal`` for each document and item that overlap; n_equal of the best window's tokens are equal.

    Words are compared in lower case without punctuation. Items without words are never
    reported, nor are null or empty texts; items of up to four words must occur whole; equal
    rows give one result row; a null id stays null in the result; an empty
    table on either side gives an empty result; other columns are not read.
    """
    every = tuple(range(len(MASKS)))
    seeds = written(texts(benchmark, item_col, item_text_col).mapInArrow(lambda batches: _hits(batches, None, every), _HIT), "seeds")
    used = tuple(sorted(r["mask"] for r in seeds.select("mask").distinct().collect()))
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(seeds))
    found = written(texts(docs, id_col, text_col).mapInArrow(lambda batches: _hits(batches, bits.value, used), _HIT), "hits")
    items = seeds.select(
        F.col("doc_id").alias("item_id"), "mask", "hash", F.col("around").alias("own"), F.least("size", F.lit(WINDOW)).alias("width")
    )
    joined = dealt_join(found, items, ["mask", "hash"])
    equal = F.zip_with("around", "own", lambda a, b: F.when((a == b) & (b != 0), 1).otherwise(0))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(BEFORE + AFTER + 1) - F.col("width")),
        F.lit(0),
        lambda best, s: F.greatest(best, F.aggregate(F.slice("equal", s, F.col("width")), F.lit(0), lambda a, x: a + x)),
    )
    return (
        joined.withColumn("equal", equal)
        .withColumn("n_equal", total.cast("long"))
        .filter(F.col("n_equal") >= F.ceil(F.col("width") * F.lit(SIMILARITY)))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_equal").alias("n_equal"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id overlaps no benchmark item, with all their columns; rows without an id stay."""
    hit = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__id")).distinct()
    # a table's size is known, so Spark broadcasts it if it is small and shuffles otherwise
    return docs.join(written(hit, "contaminated"), col(id_col).cast("long") == F.col("__id"), "left_anti")


ORACLE = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_SQL_WORD}')) AS word,
    generate_subscripts(regexp_extract_all(lower(text), '{_SQL_WORD}'), 1) AS p FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '{_SQL_WORD}') AS words FROM benchmark),
t AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS q, least(len(words), {WINDOW}) AS width FROM i),
e AS (SELECT DISTINCT doc_id, item_id, width, p - q AS shift, q FROM d JOIN t USING (word)),
w AS (SELECT doc_id, item_id, width, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q
    RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS n FROM e)
SELECT doc_id, item_id, max(n) AS n_equal FROM w WHERE n >= (4 * width + 4) // 5 GROUP BY doc_id, item_id
"""
