"""Media columns: TIFF files in a binary column.

``read_media`` walks the image directories of each file, decodes strips or
tiles, undoes the predictor and gives an array of pages; ``pages`` has one row
per page. ``store`` is the lossless writer for byte payloads that the query
and the tests read back.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import col, texts

WIDTH, PAGE_ROWS, STRIP_ROWS, TILE_WIDTH, TILE_ROWS, TILE_FROM = 576, 2048, 256, 192, 32, 64
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: How a payload is stored, chosen by its CRC-32: compression, predictor, and tiles in pages of TILE_FROM rows or more.
FORMS = tuple((kind, predictor, tiled) for tiled in (False, True) for kind, predictor in ((DEFLATE, 1), (LZW, 1), (PACKBITS, 1), (DEFLATE, 2)))
_CLEAR, _END, _FIRST, _LAST = 256, 257, 258, 4094
_PAGE = (
    "page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
)
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)
#: Bytes of a value of each field type.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
#: Bytes that one stored byte can stand for at most.
_MOST = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 128}
_INTS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q", 17: "q", 18: "Q"}


def packbits(row: bytes) -> bytes:
    """PackBits of one row."""
    out, at = [], 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            part = row[k : min(k + 128, end)]
            out.append(bytes([len(part) - 1]) + part)

    for run in _RUN.finditer(row):
        literal(run.start())
        out.append(bytes([257 - (run.end() - run.start())]) + run[1])
        at = run.end()
    literal(len(row))
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while have < size and at < len(data):
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        have += len(part)
    return b"".join(out)


#: Bits of the j-th code after a clear code, and where it begins; a block has at most this many codes.
_BITS = np.array([9 if 257 + j < 511 else 10 if 257 + j < 1023 else 11 if 257 + j < 2047 else 12 for j in range(_LAST - _FIRST + 2)])
_BEGIN = np.concatenate([[0], np.cumsum(_BITS)])


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, a clear code before the table is full."""
    codes: list[int] = []
    sizes: list[np.ndarray] = [np.array([9])]
    all_codes: list[int] = [_CLEAR]
    table: dict[int, int] = {}
    if not data:
        all_codes.append(_END)
        sizes.append(_BITS[:1])
        return _packed(all_codes, sizes)
    code, free, get = data[0], _FIRST, table.get
    for byte in data[1:]:
        known = get(code << 8 | byte)
        if known is not None:
            code = known
            continue
        codes.append(code)
        table[code << 8 | byte] = free
        code = byte
        if free == _LAST:
            codes.append(_CLEAR)
            all_codes += codes
            sizes.append(_BITS[: len(codes)])
            codes, free = [], _FIRST
            table.clear()
        else:
            free += 1
    codes += [code, _END]
    all_codes += codes
    sizes.append(_BITS[: len(codes)])
    return _packed(all_codes, sizes)


def _packed(codes: list[int], sizes: list[np.ndarray]) -> bytes:
    values, bits = np.array(codes), np.concatenate(sizes)
    step = np.arange(12)
    shown = (values[:, None] >> (bits[:, None] - 1 - step)) & 1
    return np.packbits(shown[step < bits[:, None]].astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    """The bytes of an LZW strip; ``size`` bounds them."""
    wide = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    words = wide[:-3] << 16 | wide[1:-2] << 8 | wide[2:-1]
    total, bit, out, have = len(data) * 8, 0, [], 0
    base = [bytes([b]) for b in range(256)] + [b"", b""]
    while have < size:
        n = int(np.searchsorted(_BEGIN, total - bit, side="right")) - 1
        if n <= 0:
            break
        at = bit + _BEGIN[:n]
        block = (words[at >> 3] >> (24 - (at & 7) - _BITS[:n]).astype(np.uint32)) & ((1 << _BITS[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((block == _CLEAR) | (block == _END))
        end = int(stops[0]) if len(stops) else n
        table, before = base.copy(), b""
        for code in block[:end].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                raise ValueError("an LZW code that isn't in the table")
            if before:
                table.append(before + entry[:1])
            out.append(entry)
            have += len(entry)
            before = entry
        if not len(stops) or block[end] == _END:
            break
        bit += int(_BEGIN[end + 1])
    return b"".join(out)


def _compressed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
    if compression == DEFLATE:
        return zlib.compress(block.tobytes(), 6)
    if compression == LZW:
        return lzw(block.tobytes())
    return b"".join(packbits(row.tobytes()) for row in block)


def store(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS) -> bytes:
    """A little-endian TIFF of grey 8-bit pages whose samples are the payload, a multiple of ``width`` long."""
    compression, predictor, tiles = FORMS[zlib.crc32(payload) % len(FORMS)]
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    out, size, link = [b"II*\0", b"\0\0\0\0"], 8, 1
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        tiled = tiles and len(page) >= TILE_FROM
        if tiled:
            rows, cols = -(-len(page) // TILE_ROWS) * TILE_ROWS, -(-width // TILE_WIDTH) * TILE_WIDTH
            full = np.zeros((rows, cols), np.uint8)
            full[: len(page), :width] = page
            blocks = [full[y : y + TILE_ROWS, x : x + TILE_WIDTH] for y in range(0, rows, TILE_ROWS) for x in range(0, cols, TILE_WIDTH)]
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        data = [_compressed(b, compression, predictor) for b in blocks]
        places = np.cumsum([size, *map(len, data)]).tolist()
        size = places.pop()
        lists = struct.pack(f"<{2 * len(data)}I", *places, *map(len, data))
        pad = -(size + len(lists)) % 2
        n, at = len(data), size
        size += len(lists) + pad
        offsets, counts = (places[0], len(data[0])) if n == 1 else (at, at + 4 * n)
        layout = [(322, 4, 1, TILE_WIDTH), (323, 4, 1, TILE_ROWS), (324, 4, n, offsets), (325, 4, n, counts)]
        strips = [(273, 4, n, offsets), (278, 4, 1, STRIP_ROWS), (279, 4, n, counts)]
        entries = [(256, 4, 1, width), (257, 4, 1, len(page)), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, predictor)]
        entries = sorted(entries + (layout if tiled else strips))
        out[link] = struct.pack("<I", size)
        directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        out += [*data, lists + b"\0" * pad, directory, b"\0\0\0\0"]
        link = len(out) - 1
        size += len(directory) + 4
    return b"".join(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The byte order and the integer tags of each image directory, classic or big."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    count, entry, link, room = ("Q", "HHQ", "Q", 8) if big else ("H", "HHI", "I", 4)
    (at,) = struct.unpack_from(order + link, data, 8 if big else 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + count, data, at)
        at += struct.calcsize(order + count)
        tags: dict[int, list[int]] = {}
        for _ in range(n):
            tag, kind, values = struct.unpack_from(order + entry, data, at)
            at += struct.calcsize(order + entry)
            if kind in _INTS:
                start = at
                if _SIZES[kind] * values > room:
                    (start,) = struct.unpack_from(order + link, data, at)
                tags[tag] = list(struct.unpack_from(f"{order}{values}{_INTS[kind]}", data, start))
            at += room
        yield order, tags
        (at,) = struct.unpack_from(order + link, data, at)


def _inflated(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression == PACKBITS:
        return unpackbits(data, size)
    raise ValueError(f"compression {compression} isn't supported")


def _pixels(data: bytes, order: str, tags: dict[int, list[int]]) -> dict:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    bits, compression, predictor = one(258, 1), one(259, 1), one(317, 1)
    if min(width, height, samples, bits) < 1:
        raise ValueError("a page without pixels")
    planes = samples if one(284, 1) == 2 else 1
    within = samples // planes
    tiled = 322 in tags
    if tiled:
        wide, high = one(322, width), one(323, height)
        offsets, counts = tags.get(324, []), tags.get(325, [])
    else:
        wide, high = width, min(one(278, height), height) or height
        offsets, counts = tags.get(273, []), tags.get(279, [])
    if wide < 1 or high < 1:
        raise ValueError("strips or tiles without pixels")
    row_bytes = (wide * within * bits + 7) // 8
    if predictor not in (1, 2) or predictor == 2 and bits not in (8, 16, 32):
        raise ValueError(f"predictor {predictor} isn't supported for {bits} bits")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    if tiled and across > 1 and bits % 8:
        raise ValueError("tiles of samples below a byte aren't supported")
    room = _MOST.get(compression, 1) * (sum(min(c, len(data)) for c in counts[: across * down * planes]) + 8)
    if planes * height * row_bytes > room or planes * down * high * across * row_bytes > 4 * room + (1 << 20):
        raise ValueError("more pixels than the strips or tiles can hold")
    full = np.zeros((planes, down * high, across * row_bytes), np.uint8)
    for k in range(across * down * planes):
        plane, place = divmod(k, across * down)
        y, x = divmod(place, across)
        rows = high if tiled else min(high, height - y * high)
        block = np.frombuffer(_inflated(data[offsets[k] : offsets[k] + counts[k]], compression, rows * row_bytes), np.uint8)
        block = block[: rows * row_bytes].reshape(rows, row_bytes)
        if predictor == 2:
            kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
            values = block.reshape(-1).view(kind).reshape(rows, wide, within)
            block = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("=")).astype(kind).view(np.uint8).reshape(rows, row_bytes)
        full[plane, y * high : y * high + rows, x * row_bytes : (x + 1) * row_bytes] = block
    used = (width * within * bits + 7) // 8
    return {
        "width": width, "height": height, "bits": bits, "samples": samples, "compression": compression,
        "predictor": predictor, "tiled": tiled, "pixels": full[:, :height, :used].tobytes(), "error": None,
    }


def read(data: bytes) -> list[dict]:
    """The pages of a file in order; what can't be read ends the list with a page that only has an error."""
    out: list[dict] = []
    try:
        for order, tags in _directories(data):
            out.append({"page": len(out), **_pixels(data, order, tags)})
    except (ValueError, struct.error, zlib.error, IndexError, OverflowError, MemoryError) as e:
        out.append({"page": len(out), "error": str(e) or type(e).__name__})
    return out


def read_media(media: DataFrame, media_col: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keys`` and ``pages``, an array of the file's pages with pixels as bytes in the file's byte order.

    A null file has no pages; what can't be read gives a page with ``error`` set;
    equal rows each give a row; an empty table gives an empty result; other
    columns are not read.
    """
    chosen = media.select(*[col(k) for k in keys], col(media_col).alias("media"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    kind = pa.list_(pa.struct([
        ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("samples", pa.int32()),
        ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string()),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = [read(m) if m is not None else [] for m in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], [*part.schema.names[:-1], "pages"])

    return chosen.mapInArrow(run, f"{fields}, pages array<struct<{_PAGE.replace(' ', ':').replace(',:', ',')}>>")


def pages(media: DataFrame, media_col: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page: ``keys``, page, width, height, bits, samples, compression, predictor, tiled, pixels, error."""
    return read_media(media, media_col, keys).select(*[col(k) for k in keys], F.inline("pages"))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes as a TIFF, padded with bytes 255 to a positive multiple of 576."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                raw = part.column(1).cast(pa.binary()).to_pylist()
                media = [store(t + b"\xff" * (-len(t) % WIDTH if t else WIDTH)) for t in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


class _Digests:
    """Digests and features of a payload, gathered page by page."""

    def __init__(self) -> None:
        self.sha, self.size, self.tail, self.pages = hashlib.sha256(), 0, b"", 0
        self.counts, self.cells = np.zeros(256, np.int64), []

    def add(self, pixels: bytes, width: int) -> None:
        self.sha.update(pixels)
        self.size += len(pixels)
        self.tail = (self.tail + pixels[-32:])[-32:]
        self.pages += 1
        page = np.frombuffer(pixels, np.uint8)
        self.counts += np.bincount(page, minlength=256)
        edges = np.linspace(0, width, 9).astype(int)[:-1]
        self.cells.append(np.add.reduceat(page.reshape(-1, width).astype(np.int64), edges, axis=1))

    def feature(self) -> str:
        """Mean, deviation, entropy and an 8 by 8 brightness hash of the rows of all pages, as text."""
        level = np.arange(256)
        mean = (self.counts * level).sum() / self.size
        spread = (self.counts * (level - mean) ** 2).sum() / self.size
        p = self.counts[self.counts > 0] / self.size
        parts = np.array_split(np.concatenate(self.cells), 8)
        cells = np.array([part.mean(axis=0) for part in parts if len(part)])
        bits = "".join("1" if v > cells.mean() else "0" for v in cells.reshape(-1))
        return f"pages={self.pages};mean={mean:.4f};std={spread**0.5:.4f};entropy={-(p * np.log2(p)).sum():.4f};hash={int(bits, 2):016x}"


def payload_digests(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` read back from ``doc_id, n_bytes, media``.

    The rows of ``pages`` are gathered as they stream past: a file's pages follow one another
    in the task that read it, and one page at a time is held.
    """
    keys = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    rows = pages(media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}), keys=keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[tuple, _Digests] | None = None

        def out() -> pa.RecordBatch:
            key, own = now
            values = [*key, own.size, own.sha.hexdigest(), zlib.crc32(own.tail), own.feature()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [*keys, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

        for batch in batches:
            for *key, page, width, pixels, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error:
                    raise ValueError(error)
                if page == 0:
                    if now is not None:
                        yield out()
                    now = tuple(key), _Digests()
                now[1].add(pixels, width)
        if now is not None:
            yield out()

    return rows.select(*keys, "page", "width", "pixels", "error").mapInArrow(
        run,
        "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string",
    ).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
