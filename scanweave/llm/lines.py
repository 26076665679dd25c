"""Line dedup: boilerplate lines that many sites share are removed.

Each line's hash gathers a HyperLogLog sketch of the sites that show it, in
one aggregation whose partial sketches merge. Lines whose estimate lies within
the sketch's error of the threshold get an exact distinct count; the others
are decided by the estimate. Then each document loses its boilerplate lines:
by a broadcast list of hashes if they are few, else by a join on the line's place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scanweave.llm.common import bounded_batches, col, dealt_join, signed, written

MIN_SITES = 8
LOG_K = 8
#: Boilerplate lines, of 16 bytes each, that are broadcast at most.
SHARED_LINES = 500_000


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, site, pos, line_hash, line_chars`` for each line that isn't blank."""
    return (
        docs.select("doc_id", "text_hash", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter(F.trim("line") != "")
        .select(
            "doc_id", "text_hash", "site", "pos",
            F.xxhash64("line").alias("line_hash"), F.char_length("line").alias("line_chars"),
        )
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """``line_hash, line_chars`` of the lines on at least ``min_sites`` distinct sites.

    A sketch of 2^log_k registers errs by 1.04 / 2^(log_k / 2); four times that
    around the threshold counts as near.
    """
    keys = ["line_hash", "line_chars"]
    error = 4 * 1.04 / math.sqrt(1 << log_k)
    low, high = min_sites * (1 - error), min_sites * (1 + error)
    sketches = lines.groupBy(*keys).agg(F.hll_sketch_agg("site", log_k).alias("sketch"))
    estimates = written(
        sketches.select(*keys, F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= math.floor(low)),
        "spread",
    )
    near = estimates.filter(F.col("sites") <= math.ceil(high)).select(*keys)
    exact = (
        lines.join(near, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.countDistinct("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    sure = estimates.filter(F.col("sites") > math.ceil(high))
    return sure.select(*keys).unionByName(exact.select(*keys))


def _cut(docs: DataFrame, text_col: str, bad_lines: Callable[[pa.RecordBatch, list[list[str]]], list[set[int]]]) -> DataFrame:
    """``docs`` without the lines at the places that ``bad_lines`` gives, where other text is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            raw = batch.column(place).to_pylist()
            split = [t.split("\n") if t is not None else [] for t in raw]
            kept, removed = [], []
            for text, own, bad in zip(raw, split, bad_lines(batch, split), strict=True):
                cuts = bool(bad) and any(line.strip(" ") != "" for k, line in enumerate(own) if k not in bad)
                kept.append("\n".join(line for k, line in enumerate(own) if k not in bad) if cuts else text)
                removed.append(len(bad) if cuts else 0)
            new = [pa.array(kept, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            fields = [(n, c) for n, c in zip(batch.schema.names, new, strict=True) if not n.startswith("__")]
            values = [pa.array(list(map(len, split)), pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c for _, c in fields), *values], [*(n for n, _ in fields), "__lines", "__removed"])

    fields = [f for f in docs.schema.fields if not f.name.startswith("__")]
    return docs.mapInArrow(run, StructType([*fields, StructField("__lines", LongType()), StructField("__removed", LongType())]))


def _cut_in_place(docs: DataFrame, boiler: DataFrame, text_col: str) -> DataFrame:
    """The text's boilerplate lines cut by a shared sorted list of line hashes, with no shuffle of texts."""
    rows = boiler.toPandas().sort_values(["line_hash", "line_chars"])
    columns = rows["line_hash"].to_numpy(np.int64), rows["line_chars"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(columns)

    def bad_lines(batch: pa.RecordBatch, split: list[list[str]]) -> list[set[int]]:
        hashes, chars = shared.value
        out: list[set[int]] = [set() for _ in split]
        if not len(hashes):
            return out
        own = np.array([signed(xxhash.xxh64_intdigest(line.encode(), 42)) for lines in split for line in lines], dtype=np.int64)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == own)
        ends = np.cumsum(list(map(len, split)))
        for k, doc in zip(hit.tolist(), np.searchsorted(ends, hit, side="right").tolist(), strict=True):
            place = k - int(ends[doc]) + len(split[doc])
            line = split[doc][place]
            same = range(int(at[k]), int(np.searchsorted(hashes, own[k], side="right")))
            if line.strip(" ") != "" and any(chars[j] == len(line) for j in same):
                out[doc].add(place)
        return out

    return _cut(docs, text_col, bad_lines)


def _cut_by_join(docs: DataFrame, boiler: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same by joins on the line's hash and the document's key, for sets of any size."""
    table = written(lines.select("doc_id", "text_hash", "pos", "line_hash", "line_chars"), "lines")
    hits = (
        dealt_join(table, boiler, ["line_hash", "line_chars"], "left_semi")
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.collect_set("pos").alias("__pos"))
    )
    same = col(id_col).cast("string").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))

    def bad_lines(batch: pa.RecordBatch, split: list[list[str]]) -> list[set[int]]:
        return [set(found or ()) for found in batch.column("__pos").to_pylist()]

    return _cut(docs.join(hits, same, "left"), text_col, bad_lines)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    shared_lines: int = SHARED_LINES,
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and ``__lines, __removed``, the numbers of lines.

    Boilerplate goes from every document that has another line with text; one that is
    boilerplate throughout is a copy and stays whole, left to near-dedup. Lines are
    cut at newlines and compared by 64 bits of hash and their length; blank lines are never boilerplate. Up to ``shared_lines`` boilerplate lines
    are broadcast; more are joined. A null text stays null and has no lines; a
    null site counts as none; equal rows are treated equally; an empty table
    gives an empty result; other columns pass through.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(
        col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
        col(site_col).cast("string").alias("site"), col(text_col).alias("text"),
    )
    lines = _lines(own)
    boiler = written(spread_lines(lines, min_sites), "boilerplate")
    if boiler.count() <= shared_lines:
        return _cut_in_place(docs, boiler, text_col)
    return _cut_by_join(docs, boiler, lines, id_col, text_col)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, text IS NULL AS missing, source FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
b AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.*, b.line IS NOT NULL AS bad FROM l LEFT JOIN b ON l.line = b.line),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad,
    count(*) FILTER (NOT bad AND trim(line, ' ') <> '') = 0 AS copy,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, CASE WHEN missing THEN 0 ELSE n_lines END AS n_lines, CASE WHEN copy THEN 0 ELSE n_bad END AS n_removed,
    sha256(CASE WHEN copy THEN text ELSE kept END) AS kept_sha256
FROM d JOIN g USING (rid)
"""
