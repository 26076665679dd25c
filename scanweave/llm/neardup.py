"""Near-dedup by exact similarity: texts whose sets of 5-word shingles have Jaccard similarity 0.8 or more.

A node is a distinct set of shingles. With the shingles of every set in one
global order, two sets of similarity t share one of their first n - ceil(t n) + 1
shingles, n being a set's size, so only equal keys among these meet and no pair
is missed. The shingles that some task meets in several texts, the most frequent of
them if they are very many, come last in the order, so common passages seldom become
keys; the links don't depend on which these are. At the first key that two sets share, what
follows in either bounds what they have in common, which rules most pairs out
before their sets move; the others are verified on the whole sets.

In a group of more than ``PAIRS_UP_TO`` nodes pairs would grow with the square,
so there each node first meets the node of the group with the fewest rarer
shingles, which is the least changed copy, and in further rounds, unless the two
are in one component already, other ones that differ from key to key, as long as
such rounds find links. Then what is still outside the largest
component of its group meets the group's nodes of other components, which leaves
the closure as it is. Such a group is cut into bands of like size and place of the key, of which
a key has some hundreds at most; only bands that may hold similar sets meet, and nodes without such
a band leave at once. So texts that share a line but too little else are not paired, however many they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import bounded_batches, col, dealt_join, texts, written
from scanweave.llm.components import connected_components

WIDTH = 5
HASH_SEED = 42
#: The least similarity as a fraction.
OVER, UNDER = 4, 5
PAIRS_UP_TO = 16
ROUNDS = 8
#: A round is the last if fewer than one in so many of its pairs are similar.
WORTH = 4
#: Sizes in one band differ by less than this factor, and so does what follows the key.
BAND = 1.05
#: Frequent shingles that come last in the order, at most; they are broadcast with 9 bytes each.
FREQUENT = 1 << 20
#: Texts of one task, of so many shingles, that must share a shingle to make it frequent.
MET, MET_IN = 3, 1 << 22
#: Remainders of text hashes, broadcast, by which texts that are in no candidate pair stay where they are.
REMAINDERS = 1 << 20
#: Bits, broadcast, of the keys that several nodes have, in words of 64: at most 2^21 rows reach the driver.
MARKS = 1 << 27
#: Bits of a shingle's hash by which whole sets are compared.
_LOW = np.uint64((1 << 40) - 1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    if len(words) <= width:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(HASH_SEED)), dtype="<u8", count=n))


def node_of(own: np.ndarray) -> int:
    """A set's identity as a signed long; the empty set is zero."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), HASH_SEED)).view(np.int64)) if len(own) else 0


def packed(own: np.ndarray) -> bytes:
    """A set's hashes, 40 bits of each, sorted, as compressed byte planes."""
    planes = np.unique(own & _LOW).view(np.uint8).reshape(-1, 8)[:, :5].T
    return zlib.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return out.reshape(-1).view("<u8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the least similarity."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def _keyed_docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = texts(docs, id_col, text_col)
    return own.select("doc_id", F.xxhash64("text").alias("th"), "text")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each shingle that several of them share, with their number."""
    names = ["doc_id", "th", "node", "key", "n"]
    seen: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate([*seen, np.empty(0, np.uint64)]), return_counts=True)
        often = counts >= MET
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(keys[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names)

    for batch in batches:
        found = []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            own = shingles(text)
            found.append(node_of(own))
            seen.append(own)
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64()), none, none], names)
        if sum(map(len, seen)) > MET_IN:
            yield out()
            seen.clear()
    yield out()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        values = [pa.array([node_of(s) for s in own], pa.int64()), pa.array(map(packed, own), pa.binary())]
        yield pa.RecordBatch.from_arrays(values, ["node", "own"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        keep = pa.array([similar(unpacked(a), unpacked(b)) for a, b in rows], pa.bool_())
        yield batch.select(["u", "v"]).filter(keep)


def _frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of ``counts(key, n)`` and twice the binary logarithm of n; the most frequent ``most`` of them at most.

    The keys of the least bin of counts on that keeps to ``most``; the bins are counted, so no task sorts all keys.
    """
    table = written(counts.select("key", F.floor(F.log2("n") * 2).cast("int").alias("bin")), "frequent")
    lowest, total = 1 << 20, 0
    for row in sorted(table.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += row["n"]
        if total > most:
            break
        lowest = row["bin"]
    rows = table.filter(F.col("bin") >= lowest).toArrow()  # rows as objects would take some hundreds of bytes each
    keys, bins = rows["key"].to_numpy(), rows["bin"].to_numpy().astype(np.int8)
    order = np.argsort(keys)
    return keys[order], bins[order]


def _keys(once: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``node, size, pos, key`` for the first shingles of each text of ``once(text)``."""
    shared = once.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bins = shared.value
        for batch in batches:
            found = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own = shingles(text)
                n = len(own)
                if n:
                    m = n - -(-OVER * n // UNDER) + 1
                    first = own.view(np.int64)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, first), len(keys) - 1)
                        first = first[np.argsort(np.where(keys[at] == first, bins[at], 0), kind="stable")]
                    found.append((np.full(m, node_of(own)), np.full(m, n, np.int32), np.arange(m, dtype=np.int32), first[:m]))
            if found:
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "size", "pos", "key"])

    return once.select("text").mapInArrow(run, "node long, size int, pos int, key long")


def _marked(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key may be in ``groups``: all that are, and few others unless ``groups`` nears ``MARKS`` keys.

    Most keys have one node; their rows are left where they are, so the join that follows doesn't move them.
    """
    bit = F.pmod("key", F.lit(MARKS))
    words = groups.select(F.floor(bit / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, int(pmod(key, {MARKS}) % 64))").alias("word"))
    rows = words.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    marks = np.zeros(MARKS >> 6, dtype="<i8")
    marks[rows["at"].to_numpy()] = rows["word"].to_numpy()
    shared = keyed.sparkSession.sparkContext.broadcast(marks.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            at = batch.column("key").to_numpy() & (MARKS - 1)
            yield batch.filter(pa.array((marks[at >> 3] >> (at & 7)) & 1 == 1, pa.bool_()))

    return keyed.mapInArrow(run, keyed.schema)


def _verify(candidates: DataFrame, once: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of the table ``candidates`` that have the least similarity.

    Texts move only if their hash has the remainder of a candidate's; there are at most ``REMAINDERS`` of these.
    """
    ids = candidates.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    chosen = written(nodes.join(ids, "node", "left_semi").select("th"), "candidates")
    remainder = F.pmod("th", F.lit(REMAINDERS)).alias("remainder")
    near = once.select("th", "text", remainder).join(F.broadcast(chosen.select(remainder).distinct()), "remainder", "left_semi")
    sets = written(near.join(chosen, "th", "left_semi").select("text").mapInArrow(_sets, "node long, own binary"), "sets")
    a, b = sets.select(F.col("node").alias("u"), F.col("own").alias("a")), sets.select(F.col("node").alias("v"), F.col("own").alias("b"))
    half = dealt_join(candidates, a, ["u"])
    return dealt_join(half, b, ["v"], counts=candidates.groupBy("v").agg(F.count("*").alias("n"))).select("u", "v", "a", "b").mapInArrow(_verified, "u long, v long")


def _possible(sa: Column, pa_: Column, sb: Column, pb: Column) -> Column:
    """Whether sets of sizes ``sa, sb`` that share their shingle at ``pa_, pb`` and none before can have the least similarity."""
    common = F.least(sa - pa_, sb - pb)
    return (OVER + UNDER) * common >= OVER * (sa + sb)


def _banded(rows: DataFrame) -> DataFrame:
    """``rows(key, node, size, pos, …)`` with ``band``: the logarithms of a set's size and of what follows the key, in steps of ``BAND``."""
    steps = [F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int") for n in (F.col("size"), F.col("size") - F.col("pos"))]
    return rows.withColumn("band", F.struct(steps[0].alias("size"), steps[1].alias("rest")))


def _meeting(rows: DataFrame) -> DataFrame:
    """The bands ``key, band, other`` of ``rows`` that may hold similar sets: by their least size and the most that follows the key."""
    bands = rows.groupBy("key", "band").agg(F.count("*").alias("n"), F.min("size").alias("size"), F.max(F.col("size") - F.col("pos")).alias("rest"))
    a, b = (bands.select("key", F.struct("band", "n", "size", "rest").alias(x)) for x in "ab")
    near = (OVER + UNDER) * F.least("a.rest", "b.rest") >= OVER * (F.col("a.size") + F.col("b.size"))
    alone = (F.col("a.band") == F.col("b.band")) & (F.col("a.n") == 1)
    return a.join(b, "key").filter(near & ~alone).select("key", F.col("a.band").alias("band"), F.col("b.band").alias("other"))


def links(once: DataFrame, nodes: DataFrame, frequent: tuple[np.ndarray, np.ndarray], known: DataFrame | None, most: int = PAIRS_UP_TO) -> DataFrame:
    """Links ``u, v`` whose closure is that of all pairs of nodes with the least similarity.

    ``once(th long, text string)`` and ``nodes(node long, th long)`` must hold each node once. ``known`` are links found
    before; only nodes that these leave apart are paired, and they are among the links returned.
    """
    keyed = written(_keys(once, frequent), "keys")
    groups = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    shared = written(dealt_join(_marked(keyed, groups), groups, ["key"], counts=groups), "shared", keyed)
    if known is None:
        known, shared = nodes.limit(0).select(F.col("node").alias("u"), F.col("node").alias("v")), shared.withColumn("root", F.col("node"))
    else:
        own = dealt_join(shared, connected_components(known), ["node"], "left")
        shared = written(own.withColumn("root", F.coalesce("root", "node")), "shared", shared)
    small, large = shared.filter(F.col("n") <= most), shared.filter(F.col("n") > most)

    def ordered(u: str, v: str) -> list[Column]:
        return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]

    a, b = (small.select("key", F.struct("node", "size", "pos", "root").alias(x)) for x in "ab")
    near = _possible(F.col("a.size"), F.col("a.pos"), F.col("b.size"), F.col("b.pos")) & (F.col("a.root") != F.col("b.root"))
    pairs = a.join(b, "key").filter((F.col("a.node") > F.col("b.node")) & near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    if large.isEmpty():
        return known.unionByName(written(_verify(written(pairs.distinct(), "pairs"), once, nodes), "links"))

    def stars(rows: DataFrame, turn: int) -> DataFrame:
        """Each node of ``rows(key, node, size, pos, root)`` with the node of its group that comes first in this turn's order: at first the least changed one."""
        rare = F.lit(0) if turn > 2 else F.col("pos")
        order = F.struct(rare.alias("rare"), F.xxhash64("node", *["key"] * turn).alias("h"), "node", "size", "pos", "root")
        centre = rows.groupBy("key").agg(F.min(order).alias("c"))
        met = dealt_join(rows.select("key", "node", "size", "pos", "root"), centre, ["key"])
        fits = _possible(F.col("size"), F.col("pos"), F.col("c.size"), F.col("c.pos"))
        return met.filter((F.col("root") != F.col("c.root")) & fits).select("node", F.col("c.node").alias("other")).select(*ordered("node", "other"))

    banded = written(_banded(large.select("key", "node", "size", "pos", "root")), "large")
    meeting = written(_meeting(banded), "bands")
    live = dealt_join(banded, meeting.select("key", "band").distinct(), ["key", "band"])
    rooted = written(live.select("key", "node", "size", "pos", "root"), "large", banded)
    if rooted.isEmpty():
        return known.unionByName(written(_verify(written(pairs.distinct(), "pairs"), once, nodes), "links"))
    found = known
    for turn in range(ROUNDS):
        candidates = stars(rooted, turn)
        tried = written((candidates.unionByName(pairs) if turn == 0 else candidates).distinct(), "pairs")
        more = written(_verify(tried, once, nodes), "links")
        found = found.unionByName(more)
        comps = connected_components(found)
        again = dealt_join(rooted.select("key", "node", "size", "pos"), comps, ["node"], "left")
        rooted = written(again.select("key", "node", "size", "pos", F.coalesce("root", "node").alias("root")), "large", rooted)
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", "n").alias("main"))
        rooted = written(dealt_join(rooted, sizes.filter("parts > 1").select("key", "main"), ["key"]), "open", rooted)
        if rooted.isEmpty():
            return found
        if turn and WORTH * more.count() < tried.count():
            break
    rooted = _banded(rooted)
    apart = rooted.filter("root != main").select("key", "band", F.struct("node", "size", "pos", "root").alias("a"))
    outside = dealt_join(apart, meeting, ["key", "band"]).select("key", F.col("other").alias("band"), "a")
    inside = rooted.select("key", "band", F.struct("node", "size", "pos", "root").alias("b"))
    rest = dealt_join(inside, outside, ["key", "band"]).filter(near).select(F.col("a.node").alias("p"), F.col("b.node").alias("q")).select(*ordered("p", "q"))
    return found.unionByName(written(_verify(written(rest.distinct(), "pairs"), once, nodes), "links"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` with one of each group of near duplicates: that of the least doc_id, then of the least text hash.

    Rows without a doc_id come after all others. Words are cut at ASCII white
    space and compared without the case of A-Z; null texts are empty, and texts
    without words are alike. Of rows that are equal in doc_id and text one stays. ``candidates`` gives pairs ``u, v`` of
    nodes from ``(th, text)`` and ``(node, th)``, which are verified first; the search is then for links between what they leave apart.
    """
    bounded_batches(docs.sparkSession)
    own = _keyed_docs(docs, id_col, text_col)
    seen = written(own.mapInArrow(_nodes, "doc_id long, th long, node long, key long, n long"), "nodes")
    rows = seen.filter("key IS NULL").select("doc_id", "th", "node")
    frequent = _frequent(seen.filter("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")))
    nodes = written(rows.groupBy("node").agg(F.min("th").alias("th"), F.count("*").alias("n")), "distinct")
    # only texts of nodes with several rows are shuffled
    several = rows.join(nodes.filter("n > 1").select("node", F.col("th").alias("first")), "node")
    dup = written(several.select("th", (F.col("th") == F.col("first")).alias("chosen")).distinct(), "several")
    alone = own.select("th", "text").join(dup, "th", "left_anti")
    first = own.select("th", "text").join(dup.filter("chosen"), "th", "left_semi").dropDuplicates(["th"])
    texts_of, node_of_text = alone.unionByName(first), nodes.select("node", "th")
    known = None
    if candidates is not None:
        tried = written(candidates(own.select("th", "text"), node_of_text), "pairs")
        known = written(_verify(tried, texts_of, node_of_text), "links")
    comps = connected_components(links(texts_of, node_of_text, frequent, known))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "n")
    kept = written(
        rows.groupBy("doc_id", "th", "node").agg(F.count("*").alias("n"))
        .join(comps, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("k"))
        .select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"), F.col("k.n").alias("__n")),
        "groups",
    )
    hashed = F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))
    found = docs.join(kept, col(id_col).cast("long").eqNullSafe(F.col("__id")) & (hashed == F.col("__th")))
    once, again = found.filter("__n = 1"), found.filter("__n > 1").dropDuplicates(["__id", "__th"])
    return once.unionByName(again).select(*[col(c) for c in docs.columns])
