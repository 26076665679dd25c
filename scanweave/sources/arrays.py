"""Stacks of frames in ``.npy`` files, as a Python data source with a partition per range of frames.

    spark.dataSource.register(NpyFrames)
    spark.read.format("npy_frames").option("frames_per_task", 64).load(path)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class NpyFrames(DataSource):
    """Frames ``(frame_id long, height int, width int, pixels array<double>)`` of an array of shape (frames, rows, columns)."""

    @classmethod
    def name(cls) -> str:
        return "npy_frames"

    def schema(self) -> str:
        return "frame_id long, height int, width int, pixels array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpyReader(self.options)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"].removeprefix("file://"), int(options.get("frames_per_task", 64))

    def _open(self) -> np.ndarray:
        stack = np.load(self.path, mmap_mode="r", allow_pickle=False)
        if stack.ndim == 2:
            stack = stack[None]
        if stack.ndim != 3:
            raise ValueError(f"{self.path} has {stack.ndim} dimensions; a stack of frames has 3")
        return stack

    def partitions(self) -> list[InputPartition]:
        n = len(self._open())
        return [_Range(a, min(a + self.step, n)) for a in range(0, n, self.step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        stack = self._open()
        _, height, width = stack.shape
        for at in range(partition.start, partition.stop, 16):
            block = np.asarray(stack[at : min(at + 16, partition.stop)], dtype=float)
            n = len(block)
            pixels = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * height * width, height * width, dtype=np.int32)), pa.array(block.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + n)), pa.array(np.full(n, height, np.int32)), pa.array(np.full(n, width, np.int32)), pixels],
                ["frame_id", "height", "width", "pixels"],
            )
