"""Suffix-array dedup: bytes covered by long strings that occur elsewhere.

Every string of ``length`` bytes picks one anchor, the k-gram of least hash
inside it, so equal strings pick equal anchors at equal places. Anchors that
occur once are dropped by a count. Around each other anchor the context is
cut that holds the strings which picked it, equal contexts are counted
together, and the contexts of an anchor meet in one task. There a suffix
array is built by two-stage sorting: suffixes smaller than their successors
are sorted directly, the others are induced by scanning the buckets, and the
common prefix of neighbours tells which strings occur again. An anchor with
more than ``GROUP_CONTEXTS`` different contexts would outgrow a task; its
strings are counted by their hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import texts, written

LENGTH = 200
GRAM = 32
GROUP_CONTEXTS = 20_000
CHUNK_BYTES = 1 << 20
_SEGMENT = 1 << 23
_BASE, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of a base modulo 2^64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 17)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last start of the strings of each anchor; every start belongs to exactly one."""
    parts = [_anchors(np.frombuffer(data[at : at + _SEGMENT + length - 1], np.uint8), at, length, gram) for at in range(0, max(1, len(data) - length + 1), _SEGMENT)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(text: np.ndarray, base: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = len(text), length - gram + 1
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _power("inverse", _INVERSE, n), out=sums[1:])
    m = n - gram + 1
    hashes = (sums[gram:] - sums[:m]) * _power("base", _BASE, m)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX1
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX2
    keyed = (hashes & ~_PLACE) | np.arange(m, dtype=np.uint64)
    rows = -(-m // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:m] = keyed
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    place = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    return hashes[place[first]], first + base, last + base


def suffix_order(text: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """The needed suffixes in order of their first ``depth`` bytes, by two-stage sorting.

    ``text`` has bytes plus one and 0 after each context. A needed suffix larger than
    its successor must have a needed successor.
    """
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(np.diff(text))
    step[text == 0] = 1  # an end is smaller than all else
    settled = np.minimum.accumulate(np.where(step != 0, np.arange(n), n - 1)[::-1])[::-1]
    small = step[settled] > 0
    direct = np.flatnonzero(needed & small)
    raw = np.concatenate([np.maximum(text - 1, 0).astype(np.uint8), np.zeros(depth, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(raw, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").reshape(-1), kind="stable")]
    direct = direct[np.argsort(text[direct], kind="stable")]  # ends first
    cuts = np.searchsorted(text[direct], np.arange(258))
    large = needed & ~small
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []

    def induce(entries: np.ndarray, own: int) -> np.ndarray:
        """The larger predecessors of ``entries`` go to their buckets; those of bucket ``own`` are returned."""
        before = entries[entries > 0] - 1
        before = before[large[before]]
        if not len(before):
            return before
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        edges = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]])).tolist()
        same = before[:0]
        for a, b in zip(edges, [*edges[1:], len(chars)], strict=True):
            if chars[a] == own:
                same = before[a:b]
            else:
                induced[chars[a]].append(before[a:b])
        return same

    for c in range(257):
        waiting = np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(waiting):
            out.append(waiting)
            waiting = induce(waiting, c)
        own = direct[cuts[c] : cuts[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out) if out else direct


def repeated_starts(contexts: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, whether the string at each start occurs elsewhere; ``counts`` has each context's places."""
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    text = np.zeros(int(ends[-1]), dtype=np.int16)
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8)
    text[:] = raw
    text += 1
    text[ends - 1] = 0
    starts = sizes - length  # of strings
    is_start = np.zeros(len(text), dtype=bool)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    is_start[:] = np.arange(len(text)) - begin[owner] < starts[owner]
    # the chain from each start to the next suffix that is sorted directly
    step = np.zeros(len(text), dtype=np.int8)
    step[:-1] = np.sign(np.diff(text))
    step[text == 0] = 1
    settled = np.minimum.accumulate(np.where(step != 0, np.arange(len(text)), len(text) - 1)[::-1])[::-1]
    small = step[settled] > 0
    nearest = np.minimum.accumulate(np.where(small, np.arange(len(text)), len(text) - 1)[::-1])[::-1]
    needed = is_start.copy()
    last = begin + starts - 1
    reach = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(reach, last, 1)
    np.add.at(reach, nearest[last] + 1, -1)
    needed |= np.cumsum(reach[:-1]) > 0
    order = suffix_order(text, needed, length)
    order = order[is_start[order]]
    again = np.zeros(len(text), dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(length, np.uint8)]), length)
    for at in range(0, len(order) - 1, 1 << 14):
        a, b = order[at : at + (1 << 14)], order[at + 1 : at + 1 + (1 << 14)]
        differs = views[a[: len(b)]] != views[b]
        prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
        hit = prefix >= length
        again[a[: len(b)][hit]] = True
        again[b[hit]] = True
    again |= is_start & (np.array(counts)[owner] > 1)
    return [again[b : b + s] for b, s in zip(begin.tolist(), starts.tolist(), strict=True)]


def runs(flags: np.ndarray) -> np.ndarray:
    """First and one past the last place of each run of true flags, in turn."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges.astype(np.int32)


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' anchor hashes with their numbers, counted by batch."""
    for batch in batches:
        found = [anchors(t)[0] for t in batch.column(1).cast(pa.binary()).to_pylist()]
        values, times = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], ["hash", "n"])


def _doc_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's key with each of its anchor hashes once."""
    import zlib

    for batch in batches:
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        found = [np.unique(anchors(t)[0]) for t in raw]
        sizes = np.array(list(map(len, found)))
        ids = pc.take(batch.column(0), pa.array(np.repeat(np.arange(len(raw)), sizes)))
        crcs = np.repeat(np.array([zlib.crc32(t) for t in raw], dtype=np.int64), sizes)
        hashes = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(crcs), pa.array(hashes)], ["doc_id", "crc", "hash"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by key, compressed for the shuffle."""
    import zlib

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        crcs = pa.array([zlib.crc32(t) for t in raw], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), crcs, pa.array(map(squeeze.compress, raw), pa.binary())], ["doc_id", "crc", "packed"])


_CONTEXT = "doc_id long, crc long, first int, id binary, hash long, n long, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of each document's repeated anchors; of equal ones in a batch the first has the bytes and their number."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        at_first: dict[bytes, int] = {}
        times: list[int] = []
        contexts: list[bytes | None] = []
        for doc_id, crc, packed, repeated in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = expand.decompress(packed) if packed else b""
            hashes, first, last = anchors(text)
            hashes = hashes.view(np.int64)
            for k in np.flatnonzero(np.isin(hashes, np.array(repeated, dtype=np.int64))).tolist():
                context = text[first[k] : last[k] + LENGTH]
                own = xxhash.xxh3_128_digest(context)
                for column, value in zip(rows, (doc_id, crc, int(first[k]), own, int(hashes[k])), strict=True):
                    column.append(value)
                known = at_first.setdefault(own, len(times))
                if known == len(times):
                    contexts.append(context)
                    times.append(1)
                else:
                    contexts.append(None)
                    times.append(0)
                    times[known] += 1
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "crc", "first", "id", "hash", "n", "context"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*rows, times, contexts], kinds, strict=True)], names)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts of contexts that come ordered by anchor; anchors are sorted together up to ``CHUNK_BYTES``."""
    ids: list[bytes] = []
    contexts: list[bytes] = []
    counts: list[int] = []
    size, now = 0, None

    def out() -> pa.RecordBatch:
        found = [runs(f) for f in repeated_starts(contexts, counts)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["id", "runs"])

    for batch in batches:
        for own, anchor, n, context in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if anchor != now and size >= CHUNK_BYTES:
                yield out()
                ids, contexts, counts, size = [], [], [], 0
            now = anchor
            ids.append(own)
            contexts.append(context)
            counts.append(n)
            size += len(context)
    if ids:
        yield out()


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of each context by hash, with the context's number of places."""
    for batch in batches:
        for own, n, context in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            starts = len(context) - LENGTH + 1
            hashes = [xxhash.xxh3_128_digest(context[s : s + LENGTH]) for s in range(starts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * starts, pa.binary()), pa.array([n] * starts, pa.int64()), pa.array(range(starts), pa.int32()), pa.array(hashes, pa.binary())],
                ["id", "n", "start", "string"],
            )


def _counted(contexts: DataFrame) -> DataFrame:
    """``id, runs`` of ``id, n, context`` by counting strings, for anchors of any number of contexts."""
    strings = contexts.mapInArrow(_string_hashes, "id binary, n long, start int, string binary")
    again = strings.groupBy("string").agg(F.sum("n").alias("places")).filter("places > 1")
    starts = strings.join(again, "string").groupBy("id").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    pairs = F.transform("starts", lambda s: F.array(s, s + 1))
    return starts.select("id", F.flatten(pairs).alias("runs"))


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """``doc_id, crc, packed, spans``: for each row, its compressed text and the starts of strings that occur elsewhere.

    ``spans`` has first and one past the last start of runs, in turn; runs may touch or
    overlap; it is null where nothing repeats.
    """
    own = texts(docs, id_col, text_col)
    counts = own.mapInArrow(_hash_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    shared = written(counts.filter("n > 1").select("hash"), "anchors")
    keyed = own.mapInArrow(_doc_hashes, "doc_id long, crc long, hash long").join(shared, "hash", "left_semi")
    lists = keyed.groupBy(F.col("doc_id").alias("__id"), F.col("crc").alias("__crc")).agg(F.collect_set("hash").alias("hashes"))
    packed = own.mapInArrow(_packed, "doc_id long, crc long, packed binary")
    same = packed.doc_id.eqNullSafe(F.col("__id")) & (packed.crc == F.col("__crc"))
    contexts = written(packed.join(lists, same).select("doc_id", "crc", "packed", "hashes").mapInArrow(_contexts, _CONTEXT), "contexts")
    distinct = written(
        contexts.filter("context IS NOT NULL").groupBy("hash", "id", "context").agg(F.sum("n").alias("n")), "distinct"
    )
    sizes = distinct.groupBy("hash").agg(F.count("*").alias("different"), F.max("n").alias("most"))
    hot = sizes.filter(F.col("different") > group_contexts).select("hash")
    dealt = distinct.join(hot, "hash", "left_anti").select("id", "hash", "n", "context")
    dealt = dealt.repartition("hash").sortWithinPartitions("hash", "id")
    found = dealt.mapInArrow(_sorted_groups, "id binary, runs array<int>").filter("size(runs) > 0")
    found = found.unionByName(_counted(distinct.join(hot, "hash", "left_semi").select("id", "n", "context")))
    found = written(found, "runs")
    spans = (
        contexts.select("doc_id", "crc", "first", "id").join(found, "id")
        .groupBy(F.col("doc_id").alias("__id"), F.col("crc").alias("__crc"))
        .agg(F.flatten(F.collect_list(F.transform("runs", lambda r: r + F.col("first")))).alias("spans"))
    )
    return packed.join(spans, same, "left").select("doc_id", "crc", "packed", "spans")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for each row: its bytes without those covered by a repeated string.

    Strings are ``LENGTH`` bytes of one text and repeat if they start at any other place,
    in the same text too; all are judged on the input. A null text is empty; texts
    shorter than a string stay whole; equal rows are copies of one another; a null
    doc_id is carried along; an empty table gives an empty result; other columns
    are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = expand.decompress(packed) if packed else b""
                gone = np.zeros(len(text) + 1, dtype=np.int32)
                if spans:
                    np.add.at(gone, spans[0::2], 1)
                    np.add.at(gone, np.array(spans[1::2]) + LENGTH - 1, -1)
                flags = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~flags].tobytes()
                rows.append((len(text), int(flags.sum()), len(runs(flags)) // 2, kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    found = repeated_strings(docs, id_col, text_col, group_contexts).select("doc_id", "packed", "spans")
    return found.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(texts_: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """Removed bytes, spans and digest of the kept bytes of each text, by a table of all strings; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts_:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for t in texts_:
        flags = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                flags[s : s + length] = True
        kept = np.frombuffer(t, np.uint8)[~flags].tobytes()
        out.append((int(flags.sum()), len(runs(flags)) // 2, hashlib.sha256(kept).hexdigest()))
    return out
