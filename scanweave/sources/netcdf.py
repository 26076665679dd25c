"""Variables of netCDF-3 files, as a Python data source with a partition per range of the first dimension.

    spark.dataSource.register(NetcdfRows)
    spark.read.format("netcdf_rows").option("variables", "counts,time").load("/scan/run.nc")

The header is read once for the plan; tasks then read the bytes of their rows of
the variables asked for, and no others.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from scanweave.sources.ranges import Ranges, listed

#: Values of the netCDF-3 format: types by their number, and the tags of the header's lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
FIRST_READ = 1 << 16
SUFFIXES = (".nc", ".cdf", ".netcdf")


@dataclass(frozen=True)
class Variable:
    """A variable's place: ``step`` bytes lie between its rows, each of ``row`` values."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    attributes: dict[str, object]
    begin: int
    step: int

    @property
    def row(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def kind(self) -> str:
        return "char" if self.dtype == "S1" else np.dtype(self.dtype).newbyteorder("=").name

    @property
    def role(self) -> str:
        return "coordinate" if self.dims == (self.name,) else "data"


@dataclass(frozen=True)
class Header:
    dims: dict[str, int]
    attributes: dict[str, object]
    variables: tuple[Variable, ...]


class _Cursor:
    """Reads a header from its start; more of the file is fetched as it is needed."""

    def __init__(self, file: Ranges) -> None:
        self.file, self.at, self.data = file, 0, b""

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            self.data += self.file.upto(len(self.data), max(FIRST_READ, self.at + n - len(self.data)))
        if self.at + n > len(self.data):
            raise ValueError("the header is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(">" + code, self.take(struct.calcsize(code)))[0]

    def padded(self, n: int) -> bytes:
        data = self.take(n)
        self.take(-n % 4)
        return data


def parse(file: Ranges) -> Header:
    """The dimensions, attributes and variables of a file, without a value."""
    c = _Cursor(file)
    if c.take(3) != b"CDF" or (version := c.number("B")) not in (1, 2, 5):
        raise ValueError("not a netCDF-3 file")
    size, place = ("q" if version == 5 else "i"), ("i" if version == 1 else "q")
    records = c.number(size)

    def name() -> str:
        return c.padded(c.number(size)).decode("utf-8", "replace")

    def count(tag: int) -> int:
        found, n = c.number("i"), c.number(size)
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("the header's lists are damaged")
        return n

    def attributes() -> dict[str, object]:
        out = {}
        for _ in range(count(ATTRIBUTE)):
            key, kind, n = name(), c.number("i"), c.number(size)
            data = c.padded(n * np.dtype(TYPES[kind]).itemsize)
            values = data.decode("utf-8", "replace") if kind == 2 else np.frombuffer(data, TYPES[kind]).tolist()
            out[key] = values if isinstance(values, str) or len(values) != 1 else values[0]
        return out

    dims = [(name(), c.number(size)) for _ in range(count(DIMENSION))]
    own, raw = attributes(), []
    for _ in range(count(VARIABLE)):
        label = name()
        ids = [c.number(size) for _ in range(c.number(size))]
        attrs, kind, _, begin = attributes(), c.number("i"), c.number(size), c.number(place)
        raw.append((label, ids, attrs, TYPES[kind], begin))
    moving = [r for r in raw if r[1] and dims[r[1][0]][1] == 0]
    bytes_of = lambda r: int(np.prod([dims[i][1] for i in r[1][1:]], dtype=np.int64)) * np.dtype(r[3]).itemsize
    record = bytes_of(moving[0]) if len(moving) == 1 else sum(-(-bytes_of(r) // 4) * 4 for r in moving)
    if records < 0:  # a writer that streams leaves the number open: it follows from the file's size
        records = (file.size - min(r[4] for r in moving)) // record if moving and record else 0
    lengths = {n: records if size_ == 0 else size_ for n, size_ in dims}
    variables = []
    for label, ids, attrs, kind, begin in raw:
        names = tuple(dims[i][0] for i in ids)
        shape = tuple(lengths[n] for n in names)
        step = record if ids and dims[ids[0]][1] == 0 else int(np.prod(shape[1:], dtype=np.int64)) * np.dtype(kind).itemsize
        variables.append(Variable(label, names, shape, kind, attrs, begin, step))
    return Header(lengths, own, tuple(variables))


def header(path: str) -> Header:
    file = Ranges(path)
    try:
        return parse(file)
    finally:
        file.close()


def describe(spark: SparkSession, path: str) -> DataFrame:
    """``path, variable, role, dims, shape, dtype, attributes`` of every variable of the files that ``path`` names, one task a file at most."""
    files = listed(path, SUFFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                rows = [(one, v.name, v.role, list(v.dims), list(v.shape), v.kind, json.dumps(v.attributes, sort_keys=True)) for v in header(one).variables]
                kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), pa.string())
                names = ["path", "variable", "role", "dims", "shape", "dtype", "attributes"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(min(len(files), 1000), 1))
    return paths.mapInArrow(run, "path string, variable string, role string, dims array<string>, shape array<long>, dtype string, attributes string")


class NetcdfRows(DataSource):
    """``index`` and a column for each of the ``variables``: a row for each index of their first dimension, which they share.

    Variables of one dimension are numbers, characters text; of more dimensions arrays, the last index fastest. Values that equal ``_FillValue`` or
    ``missing_value`` are null. Options: ``variables`` (by default all that share the first one's first dimension), ``rows_per_task``.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf_rows"

    def _chosen(self) -> list[Variable]:
        known = header(self.options["path"]).variables
        asked = [n.strip() for n in self.options.get("variables", "").split(",") if n.strip()]
        by_name = {v.name: v for v in known}
        if missing := [n for n in asked if n not in by_name]:
            raise ValueError(f"{self.options['path']} has no variable {missing[0]!r}")
        chosen = [by_name[n] for n in asked] or [v for v in known if v.dims[:1] == known[0].dims[:1]]
        if len({v.dims[:1] for v in chosen}) != 1:
            raise ValueError("the variables don't share their first dimension")
        return chosen

    def schema(self) -> str:
        return "index long, " + ", ".join(f"`{v.name}` {_kind(v)}" for v in self._chosen())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._chosen(), int(self.options.get("rows_per_task", 4096)))


def _kind(v: Variable) -> str:
    if v.dtype == "S1":
        return "string"
    return "double" if len(v.shape) < 2 else "array<double>"


@dataclass
class _Rows(InputPartition):
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, variables: list[Variable], step: int) -> None:
        self.path, self.variables, self.step = path, variables, step

    def partitions(self) -> list[InputPartition]:
        n = self.variables[0].shape[0] if self.variables[0].shape else 1
        return [_Rows(a, min(a + self.step, n)) for a in range(0, n, self.step)] or [_Rows(0, 0)]

    def _column(self, file: Ranges, v: Variable, start: int, stop: int) -> pa.Array:
        size = v.row * np.dtype(v.dtype).itemsize
        if v.step == size or stop - start == 1:
            data = file.read(v.begin + start * v.step, (stop - start - 1) * v.step + size)
        else:
            data = b"".join(file.read(v.begin + k * v.step, size) for k in range(start, stop))
        if v.dtype == "S1":
            return pa.array([data[k * size : (k + 1) * size].rstrip(b"\0").decode("utf-8", "replace") for k in range(stop - start)], pa.string())
        raw = np.frombuffer(data, v.dtype)
        gone = np.isnan(raw) if raw.dtype.kind == "f" else np.zeros(len(raw), bool)
        for key in ("_FillValue", "missing_value"):
            if isinstance(v.attributes.get(key), (int, float)):
                gone |= raw == np.asarray(v.attributes[key]).astype(raw.dtype)
        values = pa.array(raw.astype(float), pa.float64(), mask=gone)
        if len(v.shape) < 2:
            return values
        return pa.ListArray.from_arrays(pa.array(np.arange(stop - start + 1, dtype=np.int32) * v.row), values)

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        widest = max(v.row for v in self.variables)
        step = max((1 << 17) // max(widest, 1), 1)
        file = Ranges(self.path)
        try:
            for at in range(partition.start, partition.stop, step):
                stop = min(at + step, partition.stop)
                columns = [pa.array(np.arange(at, stop)), *[self._column(file, v, at, stop) for v in self.variables]]
                yield pa.RecordBatch.from_arrays(columns, ["index", *[v.name for v in self.variables]])
        finally:
            file.close()
