"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint's 64 bits are four blocks of 16. Two fingerprints that differ in
at most two bits agree on at least two whole blocks, so each fingerprint is
keyed by the six pairs of blocks and only equal keys meet. Small key groups
are joined and verified by Hamming distance. In a group of more than
``PAIRS_UP_TO`` fingerprints pairs would grow with the square, so there each
fingerprint is listed under itself and its one-bit changes of the 32 free bits
instead: two fingerprints within two bits share such a variant, all that share
one are within two bits of one another, and a star to the least of them keeps
every link's closure in linear space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm import neardup
from scanweave.llm.common import dealt_join, signed, texts, written
from scanweave.llm.components import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
BLOCK_BITS = 16
PAIRS_UP_TO = 16
_SLICE = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text as an unsigned integer.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` cuts at space and
    x09-x0D alone, which are the contract's rules.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SLICE):
        part = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        values = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for each row; fp is the fingerprint as a signed long. A null text counts as empty: zero."""
    return texts(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    blocks = [((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * i) for i in range(64 // BLOCK_BITS)]
    keys = [
        F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(a | b))).alias("value"))
        for k, (a, b) in enumerate(combinations(blocks, 2))
    ]
    return fps.select("fp", F.inline(F.array(*keys)).alias("block", "value"))


def links(fps: DataFrame) -> DataFrame:
    """Links ``u, v`` whose closure is that of all pairs of distinct fingerprints within two bits.

    ``fps(fp long)`` must hold each fingerprint once.
    """
    keyed = _keyed(fps)
    sizes = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(keyed.join(sizes, ["block", "value"]), "blocks")
    small, large = shared.filter(F.col("n") <= PAIRS_UP_TO), shared.filter(F.col("n") > PAIRS_UP_TO)
    a, b = small.select("block", "value", F.col("fp").alias("u")), small.select("block", "value", F.col("fp").alias("v"))
    pairs = a.join(b, ["block", "value"]).filter("u > v AND bit_count(u ^ v) <= 2").select("u", "v")
    blocks = [list(range(BLOCK_BITS * i, BLOCK_BITS * (i + 1))) for i in range(64 // BLOCK_BITS)]
    free = [
        F.array(*[F.lit(signed(1 << bit)) for i, own in enumerate(blocks) if i not in pair for bit in own])
        for pair in combinations(range(len(blocks)), 2)
    ]
    flips = F.concat(F.array(F.lit(0).cast("long")), F.element_at(F.array(*free), F.col("block") + 1))
    variants = large.select("block", "fp", F.explode(flips).alias("flip")).select(
        "block", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")
    )
    same = Window.partitionBy("block", "variant")  # at most 33 rows
    stars = variants.select(F.col("fp").alias("u"), F.min("fp").over(same).alias("v")).filter("u != v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` for each row of ``docs``.

    Documents are linked if their fingerprints differ in at most two bits;
    component_id is the least doc_id reachable, itself included. Null texts
    are empty; empty texts have fingerprint zero and link like any other; equal
    rows each give a row; a null doc_id is carried along and never becomes a
    component_id unless all of the component's are null; an empty table gives
    an empty result; other columns of ``docs`` are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    once = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comps = connected_components(links(once.select("fp")))
    rooted = written(
        once.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(first, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def candidates(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of ``nodes(node long, th long)``, u the larger, by the texts of ``rows(th long, text string)``, whose closure is that of all with fingerprints within two bits.

    Nodes of one fingerprint meet the least of them; of two linked fingerprints the least nodes meet. Texts stay where they are.
    """
    found = rows.select("th", "text").mapInArrow(_fingerprints, "doc_id long, fp long").withColumnRenamed("doc_id", "th")
    own = written(written(found, "texts").join(nodes, "th").select("node", "fp").distinct(), "fingerprints")
    least = written(own.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    equal = dealt_join(own, least, ["fp"]).select("node", F.col("least").alias("other"))
    u, v = (least.select(F.col("fp").alias(c), F.col("least").alias(name)) for c, name in (("u", "node"), ("v", "other")))
    near = dealt_join(dealt_join(written(links(least.select("fp")), "links"), u, ["u"]), v, ["v"]).select("node", "other")
    pairs = equal.unionByName(near).filter("node != other")
    return pairs.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each group of near duplicates: texts of 5-word similarity 0.8 or more.

    SimHash gives the first candidates, which are verified exactly. Two bits reach close copies only (texts at 0.8 differ in about ten),
    so what it leaves apart is searched by ``neardup``'s exact way for the rest: no link is lost.
    """
    return neardup.representatives(docs, id_col, text_col, candidates)
