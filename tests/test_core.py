"""Operators on planted signals, edge cases, sources, sinks, streams and the workspace."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanweave import model
from scanweave.functions import physics
from scanweave.operators import combine, curves, fitting, imaging, pumpprobe, reductions, scans, scattering
from scanweave.sources import arrays, packages, spec_text
from scanweave.streaming import deduplicated, watch, windowed
from scanweave.workspace import Catalog, Workspace


def curve(spark, x, y, **more):
    rows = [(float(a), None if b is None else float(b), *(v[i] for v in more.values())) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "x double, y double" + "".join(f", {k} double" for k in more))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def planted(spark):
    """Per pixel a Gaussian in the motor, its centre linear in x."""
    frames = spark.range(41).select(F.col("id").alias("frame_id"), (F.col("id") * 0.1 - 2).alias("mu"))
    grid = spark.range(5).select(F.col("id").cast("int").alias("y")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("x")))
    centre = (F.col("x") - 2) * 0.2
    return frames.crossJoin(grid).withColumn("v", 4000 * F.exp(-0.5 * F.pow((F.col("mu") - centre) / 0.3, F.lit(2))))


def test_com_and_gaussian_maps_find_the_planted_centres(spark):
    cells = planted(spark)
    for r in reductions.com_map(cells, "mu", 0.0).collect():
        assert r["com"] == pytest.approx((r["x"] - 2) * 0.2, abs=1e-3) and r["width"] == pytest.approx(0.3, abs=2e-3)
    for r in imaging.gaussian_peak_maps(cells, "mu").collect():
        assert (r["centre"], r["sigma"], r["amplitude"]) == pytest.approx(((r["x"] - 2) * 0.2, 0.3, 4000), rel=1e-6, abs=1e-9)


def test_reduction_does_not_depend_on_partitioning(spark):
    cells = planted(spark)
    key = lambda df: sorted((r["y"], r["x"], round(r["com"], 9)) for r in reductions.com_map(df, "mu").collect())
    assert key(cells) == key(cells.repartition(7, "mu"))


def test_roi_then_reduce_is_reduce_of_the_filtered(spark):
    cells = planted(spark)
    roi = model.Roi({"y": (1, 3), "mu": (-0.5, 0.5)})
    inside = roi.of(cells)
    assert {r["y"] for r in inside.select("y").distinct().collect()} == {1, 2}
    assert one(inside.agg(F.count("*").alias("n")))["n"] == 2 * 5 * inside.select("mu").distinct().count()


def test_argmax_takes_the_earliest_of_a_tie(spark):
    df = spark.createDataFrame([(0, 0, 2, 5.0, 1.0), (0, 0, 1, 5.0, 7.0), (0, 0, 3, 4.0, 9.0)], "y int, x int, frame_id long, v double, m double")
    made = reductions.ACCUMULATORS["argmax_motor"]("m")
    assert one(reductions.reduce(df, [made])[("y", "x")])["argmax"] == 7.0


def test_accumulators_are_not_overwritten_silently():
    with pytest.raises(KeyError):
        reductions.register_accumulator("sum")(lambda: None)


def test_histogram_closes_the_last_bin_and_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 4.0, float("nan"), float("inf"), None)], "v double")
    assert {r["bin"]: r["n"] for r in reductions.histogram(df, "v", 4).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    assert reductions.histogram(df.filter("v > 100 AND v < 200"), "v", 4).count() == 0


def test_on_off_modes_differ_on_other_flags(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (float("nan"),), (None,)], "f double")
    loose = [r[0] for r in df.select(reductions.on_off(F.col("f"))).collect()]
    strict = [r[0] for r in df.select(reductions.on_off(F.col("f"), True)).collect()]
    assert loose == ["on", "off", "off", "off"] and strict == ["on", "off", None, None]


@pytest.mark.parametrize("value,decimals,want", [(1.005, 2, 1.0), (1.015, 2, 1.01), (2.675, 2, 2.67), (0.125, 2, 0.12), (1.255, 2, 1.25)])
def test_rounding_is_that_of_arrays(spark, value, decimals, want):
    assert one(spark.range(1).select(pumpprobe.round_even(F.lit(value), decimals).alias("r")))["r"] == float(np.round(value, decimals))
    assert abs(float(np.round(value, decimals)) - want) < 0.011


def test_bin_events_puts_the_last_edge_into_the_last_bin(spark):
    df = spark.createDataFrame([(0.0, 1, 1.0, 1.0), (10.0, 1, 1.0, 1.0), (5.0, 0, 1.0, 1.0), (5.0, None, 1.0, 1.0)], "d double, f int, i0 double, v double")
    got = {(r["laser"], r["bin"]): r["n_shots"] for r in pumpprobe.bin_events(df, "d", F.col("f"), "i0", ("v",), 2).collect()}
    assert got == {("on", 0): 1, ("on", 1): 1, ("off", 1): 1}
    assert pumpprobe.bin_events(df.limit(0), "d", F.col("f"), "i0", ("v",), 2).count() == 0


def test_derivative_is_second_order_on_uneven_points(spark):
    x = [0.0, 1.0, 3.0, 4.0, 6.0]
    got = {r["x"]: r["dy"] for r in curves.derivative(curve(spark, x, [v * v for v in x])).collect()}
    assert got == pytest.approx(dict(zip(x, np.gradient(np.square(x), x), strict=True)))


def test_integral_and_smoothing(spark):
    x = [0.0, 1.0, 2.0, 4.0]
    got = [r["integral"] for r in curves.cumulative_integral(curve(spark, x, x)).orderBy("x").collect()]
    assert got == pytest.approx([0, 0.5, 2, 8])
    smooth = [r["smooth"] for r in curves.moving_average(curve(spark, x, [3.0, 0.0, 0.0, 3.0]), 1).orderBy("x").collect()]
    assert smooth == pytest.approx([2, 1, 1, 2])


def test_peak_methods_and_width(spark):
    x = np.linspace(-3, 3, 121)
    c = curve(spark, x, np.exp(-0.5 * ((x - 0.33) / 0.5) ** 2))
    assert one(curves.peak_position(c))["peak"] == pytest.approx(0.35)
    assert one(curves.peak_position(c, "parabola"))["peak"] == pytest.approx(0.33, abs=1e-3)
    assert one(curves.peak_position(c, "com"))["peak"] == pytest.approx(0.33, abs=0.02)
    assert one(curves.fwhm(c))["fwhm"] == pytest.approx(2.3548 * 0.5, abs=2e-3)
    assert one(curves.fwhm(c.filter("x < 0.4")))["fwhm"] is None
    with pytest.raises(ValueError):
        curves.peak_position(c, "other")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-5, 5)), min_size=2, max_size=20, unique_by=lambda t: t[0]), st.floats(-5, 55))
def test_interpolation_equals_the_array_one(spark, points, at):
    points = sorted(points)
    x, y = zip(*points, strict=True)
    got = one(curves.interpolate_onto(curve(spark, x, y), spark.createDataFrame([(at,)], "x double")))["y"]
    if at < x[0] or at > x[-1]:
        assert got is None
    else:
        assert got == pytest.approx(float(np.interp(at, x, y)), abs=1e-9)


def test_merge_points_chains_and_propagates(spark):
    got = curves.merge_points(curve(spark, [0, 0.4, 0.8, 5], [1, 2, 3, 9], sigma=[0.3, 0.4, 0.0, 1.0]), 0.5).orderBy("x").collect()
    assert [(r["x"], r["y"]) for r in got] == [(pytest.approx(0.4), 2.0), (5.0, 9.0)]
    assert got[0]["sigma"] == pytest.approx(0.5 / 3)


def test_stitch_scales_the_second_curve(spark):
    a, b = curve(spark, [0, 1, 2], [2, 4, 6]), curve(spark, [2, 3], [3, 4])
    assert {r["x"]: r["y"] for r in curves.stitch_pair(a, b).collect()} == {0: 2, 1: 4, 2: 6, 3: 8}


def test_arithmetic_propagates_uncertainty_and_broadcasts(spark):
    a = spark.createDataFrame([(0, 0, 8.0, 0.4), (0, 1, 6.0, 0.3)], "y int, x int, value double, sigma double")
    b = spark.createDataFrame([(0, 2.0, 0.1), (1, 0.0, 0.1)], "x int, value double, sigma double")
    got = {r["x"]: (r["value"], r["sigma"]) for r in combine.arithmetic(a, b, "/", ("y", "x")).collect()}
    assert got[0] == (4.0, pytest.approx(4 * math.hypot(0.05, 0.05))) and got[1] == (None, None)


def test_varying_and_selection(spark):
    df = spark.createDataFrame([(1, "complete", 1.0, 5.0), (2, "running", 2.0, 5.0), (3, "aborted", 3.0, None)], "id int, status string, a double, b double")
    assert [r["column"] for r in scans.varying(df, {"a": 0.1, "b": 0.1}).collect()] == ["a"]
    assert [r["id"] for r in scans.select(df, {"a": (2.5, None)}).collect()] == [3]
    assert [r["id"] for r in scans.select(df, {"a": 2.0}, None).collect()] == [2]
    assert scans.groups(df, ("b",)).count() == 1


def test_scan_status_rules(spark):
    rows = [(False, False, True, 0, 5), (True, True, True, 0, 5), (True, True, True, 3, 5), (True, True, False, 5, 5), (True, True, True, 5, 5)]
    df = spark.createDataFrame(rows, "s boolean, e boolean, ok boolean, n int, p int")
    got = [r[0] for r in df.select(scans.status(F.col("s"), F.col("e"), F.col("ok"), F.col("n"), F.col("p"))).collect()]
    assert got == ["running", "empty", "aborted", "aborted", "complete"]


def test_kam_skips_missing_neighbours(spark):
    image = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (5, 5, 2.0)], "y int, x int, v double")
    assert {(r["y"], r["x"]): r["kam"] for r in imaging.kam(image, "v").collect()} == {(0, 0): 2.0, (0, 1): 2.0}


@pytest.mark.parametrize("how,f", [("flip_y", np.flipud), ("flip_x", np.fliplr), ("transpose", np.transpose), ("rot90", np.rot90), ("rot270", lambda a: np.rot90(a, 3)), ("rot180", lambda a: np.rot90(a, 2))])
def test_transforms_equal_the_array_ones(spark, how, f):
    a = np.arange(6.0).reshape(2, 3)
    image = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(2) for x in range(3)], "y int, x int, v double")
    out = f(a)
    got = {(r["y"], r["x"]): r["v"] for r in imaging.transform(image, how, 2, 3).collect()}
    assert got == {(y, x): out[y, x] for y in range(out.shape[0]) for x in range(out.shape[1])}


def test_masks(spark):
    image = spark.createDataFrame([(0, 0, 1.0), (0, 1, 9.0)], "y int, x int, v double")
    assert {r["x"]: r["v"] for r in imaging.mask_pixels(image, 0, 5).collect()} == {0: 1.0, 1: None}


def test_ring_calibration_finds_distance_and_centre(spark):
    n, r = 64, 20.0
    grid = spark.range(n * n).select(F.expr(f"int(id div {n})").alias("y"), (F.col("id") % n).cast("int").alias("x"))
    d = F.hypot(F.col("y") - 30.5, F.col("x") - 33.0) - r
    image = grid.withColumn("v", F.exp(-d * d))
    got = one(scattering.calibrate_ring(image, 3.1356, 12.0, 100.0, 95.0))
    angle = math.radians(math.degrees(2 * math.asin(physics.HC_KEV_A / 12 / 2 / 3.1356)))
    assert (got["centre_y"], got["centre_x"]) == (pytest.approx(30.5, abs=0.1), pytest.approx(33.0, abs=0.1))
    assert got["distance_mm"] == pytest.approx(r * 0.1 / math.tan(angle), rel=0.01)


def test_lattice_metric_of_a_skew_cell(spark):
    m = physics.inverse_metric(3.0, 4.0, 5.0, 90.0, 100.0, 90.0)
    d = 1 / math.sqrt(m[2])
    assert d == pytest.approx(5.0 * math.sin(math.radians(100.0)))
    odd = spark.createDataFrame([(-1, 1, 1), (-1, 0, 1)], "h int, k int, l int").select(physics.allowed(F.col("h"), F.col("k"), F.col("l"), "F")).collect()
    assert [r[0] for r in odd] == [True, False]


@pytest.mark.parametrize("shape", ["gaussian", "lorentzian", "step"])
def test_fits_recover_planted_parameters(spark, shape):
    x = np.linspace(-4, 4, 81)
    want = np.array([[0.4, 0.6, 5.0, 1.0], [-1.1, 0.9, 2.0, 0.2]])
    y = fitting._model(shape, x, want)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)] + [(9, None), (8, [1.0])], "id int, y array<double>")
    got = {r["id"]: r for r in fitting.fit_peaks(df, "id", x.tolist(), shape=shape).collect()}
    for i, p in enumerate(want):
        assert [got[i][n] for n in ("centre", "sigma", "amplitude", "offset")] == pytest.approx(p, abs=1e-4) and got[i]["success"]
    assert not got[9]["success"] and got[8]["centre"] is None


def test_phase_correlation_and_smoothing(spark):
    a = np.zeros((8, 8))
    a[2:4, 3:5] = 1
    df = spark.createDataFrame([(1, np.roll(a, (2, -1), (0, 1)).reshape(-1).tolist())], "id int, pixels array<double>")
    got = one(fitting.phase_correlation_shift(df, "id", a.reshape(-1).tolist(), 8, 8))
    assert (got["dy"], got["dx"]) == (2, -1)
    assert sum(one(fitting.gaussian_smooth(df, "id", 8, 8, 1.0))["pixels"]) == pytest.approx(4.0, rel=1e-9)


SPEC = """#F session
#S 1 ascan th 0 1 2 0.5
#N 3
#L th  Det One  ic0
0 10 1
0.5 20 bad
1 30 3 4
#S 2 loopscan 3 1
#N 1
#L t
#C scan aborted after 0 points
#S 1 ascan th 0 2 1 0.5
#N 2
#L th  ic0
0 5
2 7
#R done
"""


def test_spec_text(spark):
    blocks = spec_text.blocks_of(spark.createDataFrame([("f", SPEC)], "path string, text string"))
    table = {r["scan"]: r for r in spec_text.scan_table(blocks).collect()}
    assert (table[1]["rows"], table[1]["planned"], table[1]["status"]) == (2, 2, "complete") and table[2]["status"] == "empty"
    rows = spec_text.scan_rows(blocks).orderBy("row").collect()
    assert [r["values"] for r in rows] == [{"th": 0.0, "ic0": 5.0}, {"th": 2.0, "ic0": 7.0}]
    parsed = spec_text.parse_commands(table_df := spec_text.scan_table(blocks)).filter("scan = 1").first()
    assert (parsed["motor"], parsed["start"], parsed["stop"], parsed["points"]) == ("th", 0.0, 2.0, 2) and table_df.count() == 2


def test_spec_label_that_has_blanks(spark):
    blocks = spec_text.blocks_of(spark.createDataFrame([("f", "#S 7 ascan th 0 1 1 1\n#N 2\n#L th  Det One\n0 1\n")], "path string, text string"))
    assert spec_text.scan_rows(blocks).first()["values"] == {"th": 0.0, "Det One": 1.0}


def test_npy_source(spark, tmp_path):
    stack = np.arange(3 * 2 * 4, dtype=np.uint16).reshape(3, 2, 4)
    np.save(tmp_path / "s.npy", stack)
    spark.dataSource.register(arrays.NpyFrames)
    df = spark.read.format("npy_frames").option("frames_per_task", 2).load(str(tmp_path / "s.npy"))
    assert df.rdd.getNumPartitions() == 2
    got = {r["frame_id"]: r for r in df.collect()}
    assert got[2]["pixels"] == stack[2].reshape(-1).tolist() and (got[0]["height"], got[0]["width"]) == (2, 4)


def test_package_is_skipped_when_unchanged(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(3)
    assert packages.write_package({"points": df}, path, {"scan": 1})
    assert not packages.write_package({"points": df}, path, {"scan": 1})
    assert packages.read_package(spark, path)["points"].count() == 3
    made = []
    make = lambda: made.append(1) or spark.range(5)
    assert [packages.cached(make, spark, str(tmp_path / "c"), {"a": 1}).count() for _ in range(2)] == [5, 5] and len(made) == 1


def test_watch_handles_each_file_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    for n in (3, 4):
        spark.range(n).coalesce(1).write.mode("append").parquet(folder)
        watch(spark, folder, "id long", lambda df, _: seen.append(df.count()), str(tmp_path / "ckpt")).awaitTermination(60)
    assert seen == [3, 4]


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "ev")
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(120)]
    spark.createDataFrame(rows, "id long, s string, v double").selectExpr("id", "timestamp(s) AS ts", "v").coalesce(1).write.parquet(folder)
    columns = (F.count("*").alias("n"), F.sum("v").alias("v"))
    batch = windowed(spark.read.parquet(folder), "ts", (), columns, "10 minutes")
    stream = windowed(spark.readStream.schema("id long, ts timestamp, v double").parquet(folder), "ts", (), columns, "10 minutes")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    assert deduplicated(spark.read.parquet(folder), "ts", "ts").count() == 60


def test_workspace_replays_its_log(spark):
    w = Workspace(spark)
    w.add("c", curve(spark, [0, 1, 2], [0, 1, 4]))
    w.run("derivative", "c", name="d")
    w.run("select_range", "d", name="e", dim="x", low=1)
    again = Workspace(spark)
    again.add("c", w.objects["c"])
    again.replay(w.script())
    assert again.objects["e"].count() == w.objects["e"].count() == 2 and spark.table("e").count() == 2
    assert json.loads(w.script().split("\n")[1])["settings"] == {"dim": "x", "low": 1}
    with pytest.raises(KeyError, match="derivative"):
        w.run("derivatve", "c", name="x")
    with pytest.raises(TypeError):
        w.run("derivative", "c", name="x", nothing=1)
    catalog = Catalog()
    catalog.register("a", curves.derivative)
    with pytest.raises(KeyError):
        catalog.register("a", curves.derivative)
