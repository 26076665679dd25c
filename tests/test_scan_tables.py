"""Tables of scans with different motors, small and odd ones."""

import pytest

from scanweave.operators import scan_tables


def test_scans_keep_their_rows_whatever_they_recorded(spark):
    scans = spark.createDataFrame([(1, "complete"), (2, "running"), (3, "complete"), (None, "empty")], "scan long, status string")
    recorded = [(1, "mu", 0.5), (1, "a.b", 2.0), (3, "mu", None), (3, "mu", 1.5), (3, "Status", 9.0), (4, "mu", 7.0), (1, None, 3.0), (None, "mu", 8.0)]
    got = scan_tables.scan_table(scans, spark.createDataFrame(recorded, "scan long, name string, value double"))
    assert got.columns == ["scan", "status", "a.b", "mu"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == {(1, "complete", 2.0, 0.5), (2, "running", None, None), (3, "complete", None, 1.5), (None, "empty", None, None)}
    none = spark.createDataFrame([], "scan long, name string, value double")
    assert scan_tables.scan_table(scans, none).columns == ["scan", "status"]
    assert scan_tables.scan_table(scans.limit(0), none).count() == 0


def test_too_many_names_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(scan_tables, "MOST_COLUMNS", 2)
    recorded = spark.createDataFrame([(1, n, 1.0) for n in "abc"], "scan long, name string, value double")
    with pytest.raises(ValueError, match="more than 2"):
        scan_tables.scan_table(spark.createDataFrame([(1,)], "scan long"), recorded)


def test_columns_that_tell_nothing_go(spark):
    names = ("z", "old", "uz", "enc", "tilt", "temp", "none")
    rows = [(1, "complete", 0, 1.0, 1.0, 0.0, 0.0, 5.0, 20.0, None), (2, "complete", 0, 2.0, 2.0, 1.0, 1.1, 5.0, 20.01, None), (3, "complete", 0, None, None, 2.0, 2.0, None, 20.0, None)]
    table = spark.createDataFrame(rows, "scan long, status string, missing int, " + ", ".join(f"{n} double" for n in names))
    rules = {"aliases": {"old": ("z",), "uz": ("enc",)}, "followers": {"uz": ("enc",), "tilt": ("z",)}, "least": {"temp": 0.1, "none": 1.0, "z": 0.5}}
    assert scan_tables.dropped_columns(table, names, **rules) == sorted(["old", "enc", "tilt", "temp", "none", "missing", "status"])
    assert scan_tables.compact(table, names, **rules).columns == ["scan", "z", "uz"]
    assert scan_tables.dropped_columns(table.limit(0), names) == sorted([*names, "missing", "status"])
    assert scan_tables.dropped_columns(table.select("scan"), names) == []
    open_ = spark.createDataFrame([("complete", 1), (None, 0)], "status string, missing int")
    assert scan_tables.dropped_columns(open_, ()) == []


def test_candidates_for_axes(spark):
    frames = spark.createDataFrame([(0.0, 1.0, float("nan")), (1.0, 1.0 + 1e-12, None), (float("inf"), 1.0, 3.0), (0.0, None, 4.0)], "mu double, still double, enc double")
    table = spark.createDataFrame([(1, 0.0, 5.0, 0.0, 3.0), (2, 1.0, 5.0, 1.0, 3.0), (3, None, 5.0, None, 3.1)], "scan long, samz double, fixed double, z double, mu double")
    got = scan_tables.motor_candidates(frames, table, {"chi": 8}, ("chi", "mu", "still", "enc"), ("fixed", "mu", "samz", "z"), ("z",), {"z": ("samz",)}, {"enc": 1.0})
    assert sorted(map(tuple, got.collect()), key=lambda r: r[4]) == [("chi", 8, "scan", True, 1), ("mu", 2, "scan", False, 2), ("enc", 2, "scan", False, 4), ("samz", 2, "stack", False, 7)]
    alone = scan_tables.motor_candidates(frames.limit(0), table.limit(0), {}, ("mu",), ("samz",))
    assert alone.collect() == []
    first = scan_tables.motor_candidates(frames, table, {}, (), ("mu", "samz", "z"), ("z",))
    assert [r["motor"] for r in sorted(first.collect(), key=lambda r: r["place"])] == ["z", "mu", "samz"]


def test_positions_of_frames_off_the_grid(spark):
    frames = spark.createDataFrame([(1, 0, 0.5), (1, 1, None), (2, 0, 0.7)], "scan long, f long, mu double")
    points = spark.createDataFrame([(1, 0, 3), (2, 0, 4)], "scan long, f long, mu_index int")
    got = scan_tables.positions(frames, points, ("mu",), ("mu",), "f", ("scan",))
    assert got.columns == ["scan", "f", "index_mu", "mu"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 0.5), (1, 1, None, None), (2, 0, 4, 0.7)]
