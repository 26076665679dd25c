"""TIFF frames and netCDF-3 variables written here byte by byte and read back."""

import struct
import zlib

import numpy as np
import pytest

from scanweave.sources import netcdf, tiff_frames


def packed_bits(data):
    out = b""
    for at in range(0, len(data), 100):
        part = data[at : at + 100]
        out += bytes([len(part) - 1]) + part if len(set(part)) > 1 or len(part) == 1 else bytes([257 - len(part)]) + part[:1]
    return out


def tiff_bytes(frame, order="<", rows=4, compression=1, big=False, **extra):
    h, w = frame.shape
    raw = frame.astype(frame.dtype.newbyteorder(order))
    strips = [raw[a : a + rows].tobytes() for a in range(0, h, rows)]
    strips = [zlib.compress(s) if compression == 8 else packed_bits(s) if compression == 32773 else s for s in strips]
    body = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42)
    body += struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0)
    offsets = []
    for s in strips:
        offsets.append(len(body))
        body += s
    wide = "Q" if big else "I"
    tags = {256: ("H", [w]), 257: ("I", [h]), 258: ("H", [frame.dtype.itemsize * 8]), 259: ("H", [compression]), 273: (wide, offsets), 277: ("H", [1]), 278: ("H", [rows])}
    tags |= {279: (wide, [len(s) for s in strips]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[frame.dtype.kind]])} | {int(k[1:]): ("H", [v]) for k, v in extra.items()}
    entries, codes = b"", {"H": 3, "I": 4, "Q": 16}
    for tag, (code, values) in sorted(tags.items()):
        data = struct.pack(f"{order}{len(values)}{code}", *values)
        room = 8 if big else 4
        if len(data) > room:
            body += data
            data = struct.pack(order + wide, len(body) - len(data))
        entries += struct.pack(order + "HH" + wide, tag, codes[code], len(values)) + data.ljust(room, b"\0")
    at = len(body)
    body += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + bytes(8)
    return body[:8] + struct.pack(order + "Q", at) + body[16:] if big else body[:4] + struct.pack(order + "I", at) + body[8:]


def frames(n, kind, h=11, w=7):
    r = np.random.default_rng(n)
    return [(r.integers(0, 200, (h, w)) if np.dtype(kind).kind in "ui" else r.normal(size=(h, w))).astype(kind) for _ in range(n)]


def load(spark, path, **options):
    spark.dataSource.register(tiff_frames.TiffFrames)
    return spark.read.format("tiff_frames").options(**options).load(str(path))


@pytest.mark.parametrize(("kind", "order", "compression", "big"), [("uint8", "<", 1, False), ("uint16", ">", 8, False), ("int32", "<", 32773, False), ("float32", ">", 1, True), ("float64", "<", 8, True)])
def test_tiffs_of_all_kinds_come_back(spark, tmp_path, kind, order, compression, big):
    own = frames(5, kind)
    own[3][:] = 7
    for k, f in enumerate(own):
        (tmp_path / f"f_{k:03d}.tif").write_bytes(tiff_bytes(f, order, 4, compression, big))
    (tmp_path / "notes.txt").write_text("no frame")
    got = sorted(load(spark, tmp_path, files_per_task=2).collect(), key=lambda r: r["frame_id"])
    assert [r["path"].rsplit("/", 1)[1] for r in got] == [f"f_{k:03d}.tif" for k in range(5)]
    for r, f in zip(got, own, strict=True):
        np.testing.assert_array_equal(np.reshape(r["pixels"], (r["height"], r["width"])), f.astype(float))
    part = sorted(load(spark, tmp_path / "f_00[123].tif", y0=3, y1=9, x0=2, x1=99).collect(), key=lambda r: r["frame_id"])
    assert len(part) == 3
    for r, f in zip(part, own[1:4], strict=True):
        assert (r["y0"], r["x0"], r["height"], r["width"]) == (3, 2, 6, 5)
        np.testing.assert_array_equal(np.reshape(r["pixels"], (6, 5)), f[3:9, 2:].astype(float))


def test_a_window_reads_only_its_rows(spark, tmp_path):
    own = frames(6, "uint16", 400, 300)
    for k, f in enumerate(own):
        (tmp_path / f"{k}.tif").write_bytes(tiff_bytes(f, rows=16))
    whole = [r["bytes_read"] for r in load(spark, tmp_path).select("bytes_read").collect()]
    got = sorted(load(spark, tmp_path, y0=100, y1=104).select("frame_id", "bytes_read").collect())
    assert min(whole) > 400 * 300 * 2
    assert [r["bytes_read"] for r in got][1:] == [8 + 4 * 300 * 2] * 5  # the first file of a task is parsed, the others are like it
    assert got[0]["bytes_read"] < 5000


def test_invalid_pixels_empty_windows_and_files_that_are_no_frames(spark, tmp_path):
    f = frames(1, "uint16")[0]
    f[2, 3] = 65535
    (tmp_path / "a.tif").write_bytes(tiff_bytes(f))
    r = load(spark, tmp_path / "a.tif", invalid=65535).first()
    assert r["pixels"][2 * 7 + 3] == 0.0 and sum(r["pixels"]) == f.sum() - 65535
    assert load(spark, tmp_path / "a.tif", y0=50).first()["pixels"] == []
    assert load(spark, tmp_path / "*.tiff").count() == 0
    other = {"text": b"hello world, no frame", "colour": tiff_bytes(f, t277=3), "tiles": tiff_bytes(f, t322=16), "lzw": tiff_bytes(f, t259=5), "cut": tiff_bytes(f)[:-90]}
    for name, data in other.items():
        (tmp_path / f"{name}.tif").write_bytes(data)
        with pytest.raises(Exception, match=f"{name}.tif"):
            load(spark, tmp_path / f"{name}.tif").collect()


def netcdf_bytes(version, dims, attributes, variables, records=None, open_end=False):
    """``variables``: name, dims, struct code of the type, values, attributes; the dimension of length 0 is that of the records."""
    types = {"b": 1, "c": 2, "h": 3, "i": 4, "f": 5, "d": 6, "q": 10}
    size, place = ("q" if version == 5 else "i"), ("i" if version == 1 else "q")
    pad = lambda b: b + bytes(-len(b) % 4)
    num = lambda n: struct.pack(">" + size, n)
    name = lambda s: num(len(s.encode())) + pad(s.encode())

    def attribute_list(items):
        out = struct.pack(">i", 12 if items else 0) + num(len(items))
        for k, (code, v) in items.items():
            data = v.encode() if code == "c" else struct.pack(f">{len(v)}{code}", *v)
            out += name(k) + struct.pack(">i", types[code]) + num(len(data) // (1 if code == "c" else struct.calcsize(code))) + pad(data)
        return out

    order, moving = list(dims), [v for v in variables if v[1] and dims[v[1][0]] == 0]

    def stored(v, row=None):
        values = np.asarray(v[3]) if row is None else np.asarray(v[3])[row : row + 1]
        return values.astype(f">{v[2]}" if v[2] != "c" else "S1").tobytes()

    def build(begins):
        out = b"CDF" + bytes([version]) + num(-1 if open_end else records or 0)
        out += struct.pack(">i", 10 if dims else 0) + num(len(dims)) + b"".join(name(d) + num(n) for d, n in dims.items())
        out += attribute_list(attributes) + struct.pack(">i", 11 if variables else 0) + num(len(variables))
        for v, at in zip(variables, begins, strict=True):
            out += name(v[0]) + num(len(v[1])) + b"".join(num(order.index(d)) for d in v[1]) + attribute_list(v[4])
            out += struct.pack(">i", types[v[2]]) + num(0) + struct.pack(">" + place, at)
        return out

    begins, at, body = [], len(build([0] * len(variables))), b""
    for v in variables:
        begins.append(at + len(body) if v not in moving else 0)
        body += pad(stored(v)) if v not in moving else b""
    first = at + len(body)
    for v in moving:
        begins[variables.index(v)] = first
        first += len(stored(v, 0)) if len(moving) == 1 else len(pad(stored(v, 0)))
    for row in range(records or 0):
        body += b"".join(stored(v, row) if len(moving) == 1 else pad(stored(v, row)) for v in moving)
    return build(begins) + body


def rows_of(spark, path, **options):
    spark.dataSource.register(netcdf.NetcdfRows)
    return spark.read.format("netcdf_rows").options(**options).load(str(path))


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("open_end", [False, True])
def test_record_and_fixed_variables_come_back(spark, tmp_path, version, open_end):
    r = np.random.default_rng(version)
    counts, time, flag = r.integers(0, 3000, (9, 2, 3)), np.arange(9) * 0.5, r.integers(0, 5, (9, 3))
    grid, label = r.normal(size=(4, 3)), np.array([list(b"one\0"), list(b"four")], np.uint8).view("S1")
    counts[2, 1, 1] = -1
    variables = [
        ("x", ("x",), "f", [1.5, 2.5, 3.5], {"units": ("c", "mm")}),
        ("grid", ("y", "x"), "d", grid, {}),
        ("counts", ("t", "two", "x"), "h", counts, {"_FillValue": ("h", [-1])}),
        ("t", ("t",), "d", time, {}),
        ("flag", ("t", "x"), "b", flag, {}),
        ("label", ("two", "y"), "c", label, {}),
        ("one", (), "i", 42, {}),
    ]
    dims = {"t": 0, "two": 2, "x": 3, "y": 4}
    path = tmp_path / "a.nc"
    path.write_bytes(netcdf_bytes(version, dims, {"title": ("c", "scan ü"), "n": ("d", [1.0, 2.0])}, variables, 9, open_end))
    head = netcdf.header(str(path))
    assert head.dims == {"t": 9, "two": 2, "x": 3, "y": 4} and head.attributes == {"title": "scan ü", "n": [1.0, 2.0]}
    seen = {x["variable"]: x for x in netcdf.describe(spark, str(tmp_path)).collect()}
    assert {k: (x["role"], x["dims"], x["shape"], x["dtype"]) for k, x in seen.items() if k in ("t", "counts", "one")} == {
        "t": ("coordinate", ["t"], [9], "float64"), "counts": ("data", ["t", "two", "x"], [9, 2, 3], "int16"), "one": ("data", [], [], "int32"),
    }
    assert seen["x"]["attributes"] == '{"units": "mm"}'
    got = sorted(rows_of(spark, path, variables="counts, t,flag", rows_per_task=2).collect())
    assert [x["t"] for x in got] == time.tolist()
    for k, x in enumerate(got):
        assert x["counts"] == [None if v == -1 else float(v) for v in counts[k].reshape(-1)] and x["flag"] == flag[k].astype(float).tolist()
    assert [x["grid"] for x in sorted(rows_of(spark, path, variables="grid").collect())] == grid.tolist()
    assert rows_of(spark, path).columns == ["index", "x"] and [x["x"] for x in sorted(rows_of(spark, path).collect())] == [1.5, 2.5, 3.5]
    assert [x["label"] for x in sorted(rows_of(spark, path, variables="label").collect())] == ["one", "four"]
    assert [tuple(x) for x in rows_of(spark, path, variables="one").collect()] == [(0, 42.0)]
    for wrong, text in (("nothing", "no variable"), ("x,t", "share")):
        with pytest.raises(Exception, match=text):
            rows_of(spark, path, variables=wrong).collect()


def test_a_single_record_variable_is_not_padded_and_columns_are_pruned(spark, tmp_path):
    small = np.arange(21).reshape(7, 3)
    (tmp_path / "one.nc").write_bytes(netcdf_bytes(1, {"t": 0, "x": 3}, {}, [("v", ("t", "x"), "b", small, {})], 7))
    assert [x["v"] for x in sorted(rows_of(spark, tmp_path / "one.nc", rows_per_task=3).collect())] == small.astype(float).tolist()
    wide = [("v", ("t",), "d", np.arange(50.0), {}), ("w", ("t", "x"), "d", np.zeros((50, 500)), {})]
    (tmp_path / "two.nc").write_bytes(netcdf_bytes(2, {"t": 0, "x": 500}, {}, wide, 50))
    head = netcdf.header(str(tmp_path / "two.nc"))
    file = netcdf.Ranges(str(tmp_path / "two.nc"))
    reader = netcdf._Reader(str(tmp_path / "two.nc"), [head.variables[0]], 10)
    assert reader._column(file, head.variables[0], 0, 50).to_pylist() == list(range(50)) and file.bytes_read == 400
    assert len(reader.partitions()) == 5
    (tmp_path / "no.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(50))
    with pytest.raises(ValueError, match="not a netCDF-3"):
        netcdf.header(str(tmp_path / "no.nc"))
    (tmp_path / "empty.nc").write_bytes(netcdf_bytes(1, {"t": 0}, {}, [("v", ("t",), "i", [], {})], 0))
    assert rows_of(spark, tmp_path / "empty.nc").count() == 0
