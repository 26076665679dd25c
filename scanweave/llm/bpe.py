"""BPE encoding and decoding over a distinct-word table.

Each task splits its texts once, at places which no token of the vocabulary
spans, and writes them as dictionaries: the distinct words of some megabytes of
text, and each text as places in that list. The words of all dictionaries
make one table of distinct words. Each is encoded once, its ids are joined with
the vocabulary's pieces, and both return to the dictionaries by position, where
every text is put together again. What moves is a word for each dictionary that
has it, not for each time it occurs; the texts themselves stay where they were
written, in buckets by dictionary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm.common import new_path, texts

#: Characters of the texts that share a dictionary; a longer text has its own.
DICTIONARY_CHARS = 1 << 24
#: Dictionaries in which a word is looked up at once; beyond them it is encoded again for the next as many.
PLACES = 100_000
#: Rows of words' ids that are gathered for one frame of each dictionary.
FRAME_ROWS = 400_000
VOCABULARY_IDS = 1 << 20
#: Bits of a word's place in its dictionary, and of a dictionary's number within its task.
PLACE_BITS, NUMBER_BITS = 28, 12
_WIDE = re.compile("[^\x00-\u024f]")
_DICTIONARY = "dictionary long, words array<string>, ids array<long>, sizes array<int>, codes binary"


def chunks_of(text: str) -> list[str]:
    """The text cut at spaces, tabs and line ends; the tokenizer drops all blanks, so no id is lost.

    Other blanks stay inside chunks and are left to the tokenizer. The tokenizer puts
    letters in lower case, so Latin texts are put in lower case before; where special
    tokens could arise from capitals, or a letter's lower case depends on its
    neighbours, texts stay as they are.
    """
    if "<|" not in text and (text.isascii() or not _WIDE.search(text)):
        text = text.lower()
    return [c for c in text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if c]


def words_of(chunk: str) -> tuple[str, ...]:
    """A chunk without the comma or full stop after its last letter, and that sign; the tokenizer splits there too."""
    if len(chunk) > 1 and chunk[-1] in ",." and chunk[-2].isalpha():
        return chunk[:-1], chunk[-1]
    return (chunk,)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class _Index(dict):
    """Counts keys up in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        return place


def planes(values: np.ndarray) -> bytes:
    """Values of 32 bits by byte planes, of which the upper ones are nearly empty."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).reshape(-1).view("<u4")


def squeezed(codes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(planes(codes))


def expanded(packed: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(packed)
    return unplaned(data, len(data) // 4)


def _dictionary(chunks: _Index, lists: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, the most frequent first, the number of words of each text, and their places in the list."""
    index = _Index()
    first, second = np.empty(len(chunks), np.int32), np.full(len(chunks), -1, np.int32)
    for k, chunk in enumerate(chunks):
        word, *sign = words_of(chunk)
        first[k] = index[word]
        if sign:
            second[k] = index[sign[0]]
    flat = np.concatenate([*lists, np.empty(0, np.int32)])
    both = np.stack([first[flat], second[flat]], axis=1)
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), list(map(len, lists)))
    sizes = np.bincount(owner, minlength=len(lists)) + np.bincount(owner[both[:, 1] >= 0], minlength=len(lists))
    places = both[both >= 0]
    order = np.argsort(-np.bincount(places, minlength=len(index)), kind="stable")
    rank = np.empty(len(index), np.int32)
    rank[order] = np.arange(len(index))
    words = list(index)
    return [words[k] for k in order.tolist()], sizes, rank[places]


def dictionaries(own: DataFrame, chars: int = DICTIONARY_CHARS) -> DataFrame:
    """The table of dictionaries of ``own(doc_id, text)``, in buckets by ``dictionary``, its number."""
    spark = own.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = task << NUMBER_BITS
        chunks, ids, lists, size = _Index(), [], [], 0

        def out() -> pa.RecordBatch:
            words, sizes, places = _dictionary(chunks, lists)
            if len(words) >> PLACE_BITS:
                raise ValueError("a text has more than 2^28 distinct words")
            if number >> NUMBER_BITS != task:  # the next task's numbers
                raise ValueError(f"a task has more than {1 << NUMBER_BITS} dictionaries; deal the texts over more tasks")
            columns = [pa.array([x], t) for x, t in zip(
                (number, words, ids, sizes.tolist(), squeezed(places)),
                (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["dictionary", "words", "ids", "sizes", "codes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = chunks_of(text)
                lists.append(np.fromiter(map(chunks.__getitem__, cut), np.int32, len(cut)))
                ids.append(doc_id)
                size += len(text) + 64
                if size >= chars:
                    yield out()
                    chunks, ids, lists, size, number = _Index(), [], [], 0, number + 1
        if ids:
            yield out()

    name, path = f"scanweave_dictionaries_{uuid.uuid4().hex}", new_path(spark, "dictionaries")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = own.mapInArrow(split, _DICTIONARY)
    rows.write.bucketBy(buckets, "dictionary").options(path=path, compression="zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def _encoder(path: str) -> Callable[[Column], Column]:
    """The column of ids of a column of words."""

    @F.arrow_udf("array<int>")
    def encoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        for column in columns:
            found = [e.ids for e in tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
            yield pa.array(found, pa.list_(pa.int32()))

    return encoded


def _with_pieces(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``rows`` with ``ids`` spread to ``at, id, piece``; a row's ids stay together and in order, as the vocabulary is broadcast."""
    known = vocabulary.select(F.col("id").cast("int").alias("id"), "piece").dropDuplicates(["id"])
    if known.count() > VOCABULARY_IDS:
        raise ValueError("the vocabulary has more than 2^20 ids")
    others = [c for c in rows.columns if c != "ids"]
    return rows.select(*others, F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(known), "id", "left")


def distinct_words(table: DataFrame, path: str, places: int = PLACES) -> DataFrame:
    """``word, places, ids``: each distinct word of the dictionaries once, with where it is: the dictionary's number, then 28 bits of place.

    No row has more than ``places`` of them: if there are more dictionaries, words are grouped by slices of these.
    """
    slices = 1 + table.count() // places
    entries = table.select("dictionary", F.posexplode("words").alias("place", "word"))
    keys = ["word"]
    if slices > 1:
        entries, keys = entries.withColumn("slice", F.pmod(F.xxhash64("dictionary"), F.lit(slices))), ["word", "slice"]
    grouped = entries.groupBy(*keys).agg(F.collect_list(F.shiftleft("dictionary", PLACE_BITS).bitwiseOR(F.col("place").cast("long"))).alias("places"))
    return grouped.select("word", "places", _encoder(path)("word").alias("ids"))


def _frame(places: np.ndarray, counts: np.ndarray, ids: np.ndarray, known: np.ndarray, pieces_: list[bytes]) -> bytes:
    """The words of one dictionary: their places, which rise, and ids; and the pieces of the ids ``known``, which rise too."""
    sizes = np.array(list(map(len, pieces_)), np.int64)
    columns = (np.diff(places, prepend=0), counts, ids, np.diff(known, prepend=0), sizes)
    body = struct.pack("<III", len(places), len(ids), len(known)) + b"".join(map(planes, columns)) + b"".join(pieces_)
    return b"\1" + zstandard.ZstdCompressor(level=3).compress(body) if len(body) > 512 else b"\0" + body


def _unframed(data: bytes) -> tuple[list[int], list[bytes], list[str]]:
    """Places, ids as little-endian integers of 32 bits, and pieces, with one blank between them, of a frame's words."""
    body = zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:]
    n, total, different = struct.unpack_from("<III", body)
    at, columns = 12, []
    for size in (n, n, total, different, different):
        columns.append(unplaned(body, size, at))
        at += 4 * size
    steps, counts, ids, known, sizes = columns
    cuts = (np.cumsum(sizes, dtype=np.int64) + at).tolist()
    pieces_ = {k: body[a:b].decode() for k, a, b in zip(np.cumsum(known).tolist(), [at, *cuts], cuts, strict=False)}
    packed, ends = ids.tobytes(), np.cumsum(counts, dtype=np.int64).tolist()
    said = list(map(pieces_.get, ids.tolist()))
    if None in said:  # the vocabulary lacks an id
        text = [" ".join(p for p in said[a:b] if p is not None) for a, b in zip([0, *ends], ends, strict=False)]
    else:
        text = [" ".join(said[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    return np.cumsum(steps).tolist(), [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)], text


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A frame for each dictionary of many words, from rows ``at, id, piece, places`` of which a word's stay together."""

    def packed(rows: pa.RecordBatch) -> pa.RecordBatch:
        at = rows.column("at")
        starts = np.flatnonzero(pc.equal(pc.fill_null(at, 0), 0).to_numpy(zero_copy_only=False))
        known = at.is_valid()
        places = rows.column("places").take(pa.array(starts))
        spread = np.diff(np.concatenate([starts, [rows.num_rows]]))
        counts = np.where(known.to_numpy(zero_copy_only=False)[starts], spread, 0)
        flat = rows.column("id").filter(known)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
        different, first = np.unique(flat.to_numpy(zero_copy_only=False), return_index=True)
        said = rows.column("piece").filter(known).take(pa.array(first))
        there = said.is_valid().to_numpy(zero_copy_only=False)
        different, said = different[there], np.array([p.encode() for p in said.drop_null().to_pylist()], object)
        where = places.flatten().to_numpy(zero_copy_only=False)
        word = np.repeat(np.arange(len(starts)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
        order = np.argsort(where, kind="stable")
        number, place = where >> PLACE_BITS, where & ((1 << PLACE_BITS) - 1)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(number[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
        numbers, frames = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[a:b]
            mine = ids.take(pa.array(word[own])).flatten().to_numpy(zero_copy_only=False)
            used = np.flatnonzero(np.isin(different, mine))
            frames.append(_frame(place[own], counts[word[own]], mine, different[used], said[used].tolist()))
            numbers.append(int(number[own[0]]))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(frames, pa.binary())], ["dictionary", "frame"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= FRAME_ROWS:
            rows = pa.Table.from_batches(waiting)
            starts = np.flatnonzero(pc.equal(pc.fill_null(rows.column("at"), 0), 0).to_numpy())
            last = int(starts[-1])
            waiting = rows.slice(last).to_batches()
            if last:
                yield packed(rows.slice(0, last).combine_chunks().to_batches()[0])
    if sum(b.num_rows for b in waiting):
        yield packed(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])


def _joined(docs: DataFrame, path: str, vocabulary: DataFrame | None, id_col: str, text_col: str, chars: int, places: int) -> DataFrame:
    """The dictionaries' ``ids, sizes, codes`` with ``frames``, what is known of their words."""
    table = dictionaries(texts(docs, id_col, text_col), chars)
    words = distinct_words(table, path, places).select("places", "ids")
    if vocabulary is None:
        spread = words.select("places", F.posexplode_outer("ids").alias("at", "id"), F.lit(None).cast("string").alias("piece"))
    else:
        spread = _with_pieces(words, vocabulary)
    once = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("places")).alias("places")
    frames = spread.select("at", "id", "piece", once).mapInArrow(_frames, "dictionary long, frame binary")
    own = frames.groupBy("dictionary").agg(F.collect_list("frame").alias("frames"))
    return table.join(own, "dictionary", "left").select("ids", "sizes", "codes", "frames")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Iterator[list[int]], list[bytes], list[str]]]:
    """For each dictionary its documents' ids, their words' places, and what the words at these places are."""
    for batch in batches:
        for ids, sizes, codes, frames in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            flat = expanded(codes)
            n = int(flat.max()) + 1 if len(flat) else 0
            own, text = [b""] * n, [""] * n
            for frame in frames or []:
                for place, i, t in zip(*_unframed(frame), strict=True):
                    own[place], text[place] = i, t
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            yield ids, (flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)), own, text


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chars: int = DICTIONARY_CHARS, places: int = PLACES
) -> DataFrame:
    """``doc_id, ids array<int>`` for each row, as the tokenizers library encodes the whole text.

    ``path`` is a tokenizer file whose pre-tokenizer drops blanks, readable on
    every executor. Null texts are empty and have no ids; equal rows each give a
    row; a null doc_id is carried along; an empty table gives an empty result;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, seqs, own, _ in _assembled(batches):
            for doc_id, seq in zip(ids, seqs, strict=True):
                found = np.frombuffer(b"".join(map(own.__getitem__, seq)), "<i4")
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _joined(docs, path, None, id_col, text_col, chars, places).mapInArrow(run, "doc_id long, ids array<int>")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``id int, piece string`` of the vocabulary, special tokens included; read once on the driver."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    by = {i: p for p, i in stored["model"]["vocab"].items()} | {t["id"]: t["content"] for t in stored["added_tokens"]}
    return spark.createDataFrame(sorted(by.items()), "id int, piece string")


def decode(encoded: DataFrame, vocabulary: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of the ids in order, one blank between them.

    Each distinct list of ids is decoded once, by a join of its ids with ``vocabulary(id, piece)``,
    which has at most 2^20 ids; lists are told apart by 128 bits of hash. Ids that the vocabulary
    lacks are dropped, null or empty lists decode to the empty text.
    """
    keys = {"__a": F.xxhash64(ids_col), "__b": F.xxhash64(F.lit(1), ids_col)}
    keyed = encoded.withColumns(keys)
    lists = keyed.select("__a", "__b", F.col(ids_col).alias("ids")).dropDuplicates(["__a", "__b"])
    parts = F.array_sort(F.collect_list(F.struct("at", "piece")))
    text = F.array_join(F.transform(parts, lambda p: p["piece"]), " ")
    found = _with_pieces(lists, vocabulary).filter("piece IS NOT NULL").groupBy("__a", "__b").agg(text.alias("decoded"))
    return keyed.join(found, ["__a", "__b"], "left").select(*encoded.columns, F.coalesce("decoded", F.lit("")).alias("decoded"))


def round_trip(
    docs: DataFrame, path: str, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = DICTIONARY_CHARS, places: int = PLACES
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded and decoded, and both digested.

    What ``encode`` and ``decode`` give; words' ids and pieces return to the dictionaries together, so
    neither the ids nor the decoded texts of a document leave the task that puts them together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, seqs, own, text in _assembled(batches):
            gaps = "" in text  # words without an id have no piece either
            counts, sums, decoded = [], [], []
            for seq in seqs:
                packed = b"".join(map(own.__getitem__, seq))
                said = map(text.__getitem__, seq)
                counts.append(len(packed) // 4)
                sums.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(" ".join(filter(None, said) if gaps else said).encode()).hexdigest())
            columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = _joined(docs, path, vocabulary, id_col, text_col, chars, places)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
