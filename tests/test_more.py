"""Rotations against all pairs, regions as text, stores that grow, counters, colours and other grids."""

import math

import numpy as np
import pytest

from scanweave import model
from scanweave.functions import physics
from scanweave.operators import curves, imaging, omega, scans
from scanweave.sources import store


def closest(vectors, k, om, mu_range, eta_range):
    """Gap and reflections of the closest pair at one rotation, by comparing all of them."""
    seen = []
    for j, (wb, wh, wv) in enumerate(vectors):
        vb, vh = math.cos(om) * wb - math.sin(om) * wh, math.sin(om) * wb + math.cos(om) * wh
        target, radius = -(wb * wb + wh * wh + wv * wv) / (2 * k), math.hypot(vb, wv)
        if radius < abs(target):
            continue
        for sign in (1, -1):
            mu = (math.degrees(math.atan2(wv, vb) + sign * math.acos(target / radius)) + 180) % 360 - 180
            eta = math.degrees(math.atan2(vh, -math.sin(math.radians(mu)) * vb + math.cos(math.radians(mu)) * wv))
            if mu_range[0] <= mu <= mu_range[1] and eta_range[0] <= eta <= eta_range[1]:
                seen.append((j, mu))
    gaps = [(abs(a - b), *sorted((i, j))) for i, a in seen for j, b in seen if i != j]
    return min(gaps, default=None)


def test_omega_offsets_equal_all_pairs(spark):
    r = np.random.default_rng(11)
    turn, _ = np.linalg.qr(r.normal(size=(3, 3)))
    vectors = [tuple(float(c) for c in turn @ v) for v in np.array([(s * a, s2 * b, 0) for s in (1, -1) for s2 in (1, -1) for a, b in ((2.4, 2.4),)] + [(0, 2.4, 2.4), (2.4, 0, -2.4), (0, -2.4, 2.4)])]
    k, ranges = 2 * math.pi * 17 / 12.398419843320026, {"mu": (-70.0, 40.0), "eta": (-180.0, 180.0)}
    df = spark.createDataFrame([("c", j, *v) for j, v in enumerate(vectors)], "crystal string, j int, wb double, wh double, wv double")
    got = omega.find_offsets(df, ("crystal",), 17.0, (-60.0, 60.0), 1.0, 101, 50, ranges).orderBy("omega").collect()
    grid = [closest(vectors, k, math.radians(-60 + i), ranges["mu"], ranges["eta"]) for i in range(120)]
    gap = [g[0] if g else math.inf for g in grid]
    want = []
    for i in range(1, 119):
        if math.isfinite(gap[i]) and gap[i] <= gap[i - 1] and gap[i] <= gap[i + 1]:
            fine = [(f[0], m, -60 + i - 1 + m * 0.02, f[1:]) for m in range(101) if (f := closest(vectors, k, math.radians(-60 + i - 1 + m * 0.02), ranges["mu"], ranges["eta"]))]
            g, _, at, pair = min(fine)
            if want and abs(at - want[-1][0]) < 0.3:
                want[-1] = (at, g, pair) if g < want[-1][1] else want[-1]
            else:
                want.append((at, g, pair))
    assert len(got) == len(want) > 2
    for x, (at, g, pair) in zip(got, want, strict=True):
        assert (x["omega"], x["gap"]) == pytest.approx((at, g), abs=1e-9) and tuple(sorted((x["first"]["j"], x["second"]["j"]))) == pair
    best = omega.find_offsets(df, ("crystal",), 17.0, (-60.0, 60.0), 1.0, 101, 2, ranges).collect()
    assert sorted(x["rank"] for x in best) == [1, 2] and {round(x["gap"], 4) for x in best} == set(sorted(round(w[1], 4) for w in want)[:2])
    assert omega.find_offsets(df.limit(0), ("crystal",), 17.0, step=10.0).collect() == []
    assert omega.find_offsets(df, ("crystal",), 17.0, step=10.0, ranges={"two_theta": (170.0, 171.0)}).collect() == []


def test_circle_counts_eta_from_zero_to_360(spark):
    df = spark.createDataFrame([(0, 3.0, 0.5, 1.5, 0.0), (1, -2.0, 2.0, 1.0, 0.0)], "j int, wb double, wh double, wv double, omega double")
    rows = omega.hits(df, (), 8.0, {"mu": (-180.0, 180.0)}, "circle").collect()
    assert rows and all(0 <= r["eta"] < 360 for r in rows)
    for r in rows:
        wb, wv = (3.0, 1.5) if r["j"] == 0 else (-2.0, 1.0)
        tilted = math.cos(math.radians(r["mu"])) * wb + math.sin(math.radians(r["mu"])) * wv
        size = {0: 3.0**2 + 0.5**2 + 1.5**2, 1: 9.0}[r["j"]]
        assert tilted == pytest.approx(-size / 16)


def test_regions_as_text_and_in_other_pixels():
    roi = model.Roi.parse(" y=700:1100, x=800: ,chi=-0.25:0.125,")
    assert roi.ranges == {"y": (700, 1100), "x": (800, None), "chi": (-0.25, 0.125)} and model.Roi.parse(roi.text()) == roi
    assert model.Roi.parse("").ranges == model.Roi.parse(None).ranges == {} and model.Roi({"m": (0.1234567891, None)}).text() == "m=0.1234567891:"
    for wrong in ("y", "y=5", "=1:2", "y=a:b", "y=1.5:2"):
        with pytest.raises(ValueError):
            model.Roi.parse(wrong)
    assert roi.scaled({"y": 4, "x": 2, "chi": 9}).ranges == {"y": (2800, 4400), "x": (1600, None), "chi": (-0.25, 0.125)}
    small = model.Roi({"y": (2, 5), "x": (None, 3), "chi": (0.0, 1.0)}).in_pixels({"y": (100.0, 4.0), "x": (8.0, 2.0)})
    assert small.ranges == {"y": (108, 120), "x": (None, 14), "chi": (0.0, 1.0)}
    assert small.indices({"y": 50, "x": 20}, {"y": (100.0, 4.0), "x": (8.0, 2.0)}) == {"y": (2, 5), "x": (0, 3)}
    assert model.Roi({"y": (-5, 500)}).indices({"y": 50, "x": 20}) == {"y": (0, 50), "x": (0, 20)}


def test_store_shows_committed_parts_only(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/results")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    assert own.version() == 0
    own.append("curves", "scan_1", rows(1, 2))
    own.append("curves", "scan_1", rows(1, 2, 3))  # once more before the commit
    with pytest.raises(KeyError):
        own.read("curves")
    assert own.commit({"title": "first"}) == 1
    other = store.Store(spark, f"file://{tmp_path}/results")
    own.append("curves", "scan_2", rows(9))
    assert sorted(r["v"] for r in other.read("curves").collect()) == [1, 2, 3]
    other.append("maps", "scan_2", spark.createDataFrame([("a", 1)], "m string, v long"))
    assert own.commit() == 2 and other.commit({"n": 2}) == 3
    assert sorted(r["v"] for r in other.read("curves").collect()) == [1, 2, 3, 9] and own.read("maps").count() == 1
    assert sorted(r["v"] for r in own.read("curves", version=1).collect()) == [1, 2, 3] and own.manifest()["attributes"] == {"title": "first", "n": 2}
    with pytest.raises(ValueError, match="has been committed"):
        other.append("curves", "scan_1", rows(5))
    with pytest.raises(ValueError, match="letters"):
        own.append("curves", "../x", rows(5))
    own.append("curves", "scan_3", spark.createDataFrame([(4, "new")], "v long, note string"))
    own.abort()
    assert own.commit() == 4 and own.read("curves").count() == 4
    own.append("curves", "scan_4", spark.createDataFrame([(4, "new")], "v long, note string"))
    own.commit()
    assert {(r["v"], r["note"]) for r in own.read("curves").collect()} == {(1, None), (2, None), (3, None), (9, None), (4, "new")}


def test_counters_without_beam_or_x_and_without_count_times(spark):
    points = spark.createDataFrame([(1.0, 10.0, 5.0, 2.0), (2.0, 12.0, 1.0, 2.0), (None, 1.0, 5.0, 1.0)], "x double, det double, ion double, sec double")
    got = {(r["channel"], r["x"]): r["value"] for r in scans.counters(points, "x", ("det", "ion"), monitor="ion", monitor_dark=0.5).collect()}
    assert got == {("det", 1.0): 2.5, ("det", 2.0): None, ("ion", 1.0): 5.0, ("ion", 2.0): 1.0}
    with pytest.raises(ValueError, match="count time"):
        scans.counters(points.drop("sec"), "x", ("det",), monitor="ion", monitor_dark=0.5)


def test_colours_of_tilts(spark):
    rows = [(0, k, a, b) for k, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (0.0, 2.0), (None, 1.0), (float("nan"), 1.0)])]
    image = spark.createDataFrame(rows, "label int, x int, a double, b double")
    got = {r["x"]: (r["red"], r["green"], r["blue"]) for r in imaging.orientation_rgb(image, "a", "b", ("label",), (0.0, 0.0), 1.0).collect()}
    assert got[0] == pytest.approx((1, 0, 0)) and got[1] == pytest.approx((0, 1, 1)) and got[2] == (1, 1, 1) and got[3] == pytest.approx((0.5, 1, 0))
    assert got[4] == got[5] == (0, 0, 0)


def test_regrid_of_three_dimensions_is_multilinear(spark):
    f = lambda a, b, c: 2 * a + 3 * b - c + a * b * c
    rows = [(float(a), float(b), float(c), float(f(a, b, c))) for a in range(3) for b in range(3) for c in (0, 2)]
    values = spark.createDataFrame(rows, "a double, x double, y double, value double")
    out = curves.regrid(values, {"a": [0.5, 9.0], "x": [1.25], "y": [0.5, 1.0]}, ("a", "x", "y"))
    assert out.columns == ["a", "x", "y", "value"]
    got = {tuple(r)[:3]: r["value"] for r in out.collect()}
    assert set(got) == {(a, 1.25, c) for a in (0.5, 9.0) for c in (0.5, 1.0)}
    assert all((v is None) if k[0] == 9.0 else v == pytest.approx(f(*k)) for k, v in got.items())


def test_slopes_carry_their_uncertainties(spark):
    rows = [("c", float(x), float(x * x), s) for x, s in ((0, 3.0), (1, 4.0), (3, 12.0))]
    df = spark.createDataFrame(rows, "c string, x double, y double, sigma double")
    got = curves.cumulative_integral(curves.derivative(df, ("c",)), ("c",)).orderBy("x").collect()
    assert [r["dy_sigma"] for r in got] == pytest.approx([5.0, math.hypot(3, 12) / 3, math.hypot(4, 12) / 2])
    assert [r["integral_sigma"] for r in got] == pytest.approx(list(np.sqrt(np.cumsum([1.5**2, 6.0**2, 12.0**2]))))
    assert curves.derivative(df.filter("x = 0"), ("c",)).first()["dy_sigma"] is None


def test_reflections_of_a_triclinic_crystal_equal_those_from_its_vectors(spark):
    """Against the reciprocal lattice by vectors; a null cell has no reflections."""
    cell = (4.0, 5.0, 6.0, 80.0, 95.0, 105.0)
    rows = [("t", *cell, 10.0), ("none", None, *cell[1:], 10.0)]
    df = spark.createDataFrame(rows, "name string, a double, b double, c double, alpha double, beta double, gamma double, energy double")
    got = {(r["h"], r["k"], r["l"]): r["d"] for r in physics.reflections(df, ("name",), "P", 2).collect()}
    a, b, c = cell[:3]
    ca, cb, cg = np.cos(np.radians(cell[3:]))
    sg = np.sqrt(1 - cg**2)
    x = c * (ca - cb * cg) / sg
    direct = np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, x, np.sqrt(c**2 - (c * cb) ** 2 - x**2)]])
    recip = np.linalg.inv(direct).T
    for hkl, d in got.items():
        assert np.isclose(d, 1 / np.linalg.norm(np.array(hkl) @ recip))
    assert (0, 0, 0) not in got and all(tuple(-i for i in hkl) not in got for hkl in got)
    assert len(got) == 62  # all that an energy of 10 keV reaches
