"""Frames in TIFF files, one file a frame, as a Python data source with a partition per range of files.

    spark.dataSource.register(TiffFrames)
    spark.read.format("tiff_frames").option("y0", 100).option("y1", 150).load("/scan/*.tif")

Of a window only the bytes of its rows are read, or the strips that hold them
where they are compressed. A detector writes all its frames alike, so a
file with the header and size of the one before isn't parsed again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from scanweave.sources.ranges import Ranges, listed

#: Values of the TIFF format: bytes and struct codes of the types that these tags use, the tags, the compressions, the kinds of samples.
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, KIND = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 339
PLAIN, DEFLATE, PACKBITS = (1,), (8, 32946), (32773,)
KINDS = {1: "u", 2: "i", 3: "f"}
#: The mark of files with offsets of 64 bits, in either order.
BIG = (b"\x2b\0", b"\0\x2b")
SUFFIXES = (".tif", ".tiff")


@dataclass(frozen=True)
class Layout:
    """Where a frame's rows are: strips of ``rows`` rows each, of these offsets and lengths."""

    height: int
    width: int
    dtype: str
    compression: int
    rows: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]


def parse(file: Ranges) -> Layout:
    """The layout of a file's first page; one sample a pixel, in strips."""
    head = file.upto(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    big = head[2:4] in BIG
    first = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    size, entry, at = (8, 20, "Q") if big else (2, 12, "H")
    n = struct.unpack(order + at, file.read(first, size))[0]
    table, tags = file.read(first + size, n * entry), {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), table[k * entry : k * entry + (12 if big else 8)])
        if kind not in TYPES:
            continue
        code = f"{order}{count}{TYPES[kind]}"
        inline = table[k * entry + (12 if big else 8) : (k + 1) * entry]
        if struct.calcsize(code) > len(inline):
            inline = file.read(struct.unpack(order + ("Q" if big else "I"), inline)[0], struct.calcsize(code))
        tags[tag] = struct.unpack(code, inline[: struct.calcsize(code)])
    height, width, bits = (tags.get(t, (0,))[0] for t in (HEIGHT, WIDTH, BITS))
    compression, kind = tags.get(COMPRESSION, (1,))[0], KINDS.get(tags.get(KIND, (1,))[0])
    wrong = (
        (tags.get(SAMPLES, (1,))[0] != 1 and "several samples a pixel") or (TILE_WIDTH in tags and "tiles") or (tags.get(PREDICTOR, (1,))[0] != 1 and "a predictor")
        or (compression not in PLAIN + DEFLATE + PACKBITS and f"compression {compression}") or ((kind is None or bits not in (8, 16, 32, 64)) and f"samples of {bits} bits")
        or ((height < 1 or width < 1 or len(tags.get(OFFSETS, ())) != len(tags.get(COUNTS, ()))) and "no strips")
    )
    if wrong:
        raise ValueError(f"a frame with {wrong} is not read")
    return Layout(height, width, f"{order}{kind}{bits // 8}", compression, min(tags.get(ROWS, (height,))[0], height), tags[OFFSETS], tags[COUNTS])


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            if head > 128:
                out += data[at + 1 : at + 2] * (257 - head)
            at += 2 if head > 128 else 1
    return bytes(out)


def window(file: Ranges, layout: Layout, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
    """The rows ``y0`` to ``y1`` and columns ``x0`` to ``x1`` of a frame, ends excluded."""
    line = layout.width * np.dtype(layout.dtype).itemsize
    parts = []
    for k in range(y0 // layout.rows, -(-y1 // layout.rows)):
        start = k * layout.rows
        a, b = max(y0, start) - start, min(y1, start + layout.rows, layout.height) - start
        if layout.compression in PLAIN:
            parts.append(file.read(layout.offsets[k] + a * line, (b - a) * line))
        else:
            strip = file.read(layout.offsets[k], layout.counts[k])
            whole = zlib.decompress(strip) if layout.compression in DEFLATE else unpack_bits(strip)
            parts.append(whole[a * line : b * line])
    return np.frombuffer(b"".join(parts), layout.dtype).reshape(y1 - y0, layout.width)[:, x0:x1]


class TiffFrames(DataSource):
    """``frame_id, path, y0, x0, height, width, pixels, bytes_read``: the window of each file, ``frame_id`` counting files in order.

    Options: ``y0, y1, x0, x1`` (ends excluded, within the frame), ``invalid`` (a value read as zero), ``files_per_task``.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_frames"

    def schema(self) -> str:
        return "frame_id long, path string, y0 int, x0 int, height int, width int, pixels array<double>, bytes_read long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


@dataclass
class _Files(InputPartition):
    first: int
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.step = options["path"], int(options.get("files_per_task", 64))
        self.ends = {k: int(options[k]) for k in ("y0", "y1", "x0", "x1") if k in options}
        self.invalid = float(options["invalid"]) if "invalid" in options else None

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path, SUFFIXES)
        return [_Files(a, files[a : a + self.step]) for a in range(0, len(files), self.step)] or [_Files(0, [])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        layout, known = None, None
        for k, path in enumerate(partition.paths):
            file = Ranges(path)
            try:
                start = file.upto(0, 8)
                head = (start + (file.upto(8, 8) if start[2:4] in BIG else b""), file.size)
                if layout is None or head != known or layout.compression not in PLAIN:
                    layout, known = parse(file), head
                y0, x0 = (max(self.ends.get(c, 0), 0) for c in ("y0", "x0"))
                y1, x1 = min(self.ends.get("y1", layout.height), layout.height), min(self.ends.get("x1", layout.width), layout.width)
                y1, x1 = max(y1, y0), max(x1, x0)
                pixels = window(file, layout, y0, y1, x0, x1).astype(float) if y1 > y0 and x1 > x0 else np.empty((0, 0))
            except (ValueError, struct.error, zlib.error) as error:
                raise ValueError(f"{path}: {error}") from error
            finally:
                file.close()
            if self.invalid is not None:
                pixels[pixels == self.invalid] = 0.0
            row = (partition.first + k, path, y0, x0, y1 - y0, x1 - x0, pixels.reshape(-1), file.bytes_read)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64())
            names = ["frame_id", "path", "y0", "x0", "height", "width", "pixels", "bytes_read"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
