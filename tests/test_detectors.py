"""Tilted detectors against matrices in NumPy, and spots against planted ones."""

import math

import numpy as np
import pytest

from scanweave.operators import powder, spots


def angles(geometry, h, w):
    t, p = math.radians(geometry.tilt_deg), math.radians(geometry.tilt_plane_deg)
    a = np.array([math.cos(p), math.sin(p), 0])
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    turn = np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * (k @ k)
    y, x = np.mgrid[:h, :w].astype(float)
    s = geometry.pixel_um * 1e-3
    lab = np.stack([(x - geometry.centre_x) * s, (y - geometry.centre_y) * s, 0 * x], axis=-1) @ turn.T + (0, 0, geometry.distance_mm)
    r = np.linalg.norm(lab, axis=-1)
    facing = np.abs(lab @ (turn @ (0, 0, 1))) / r
    return np.degrees(np.arccos(lab[..., 2] / r)), np.degrees(np.arctan2(lab[..., 1], lab[..., 0])), facing * (geometry.distance_mm / r) ** 2


GEOMETRY = powder.TiltedGeometry(80.0, 7.3, 4.1, 900.0, 12.0, 25.0, 70.0)


def cells_of(spark, frames):
    rows = [(k, i, j, float(v)) for k, f in enumerate(frames) for (i, j), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, "k int, y int, x int, v double")


def test_pixel_table(spark):
    tt, chi, solid = angles(GEOMETRY, 9, 7)
    got = {(r["y"], r["x"]): (r["two_theta"], r["chi"], r["solid_angle"]) for r in powder.pixel_table(spark, GEOMETRY, 9, 7).collect()}
    assert len(got) == 63
    for (i, j), v in got.items():
        assert v == pytest.approx((tt[i, j], chi[i, j], solid[i, j]), abs=1e-9)
    flat = powder.pixel_table(spark, powder.TiltedGeometry(80.0, 4.0, 3.0, 900.0, 12.0), 9, 7).filter("y = 4 AND x = 3").first()
    assert (flat["two_theta"], flat["solid_angle"]) == pytest.approx((0.0, 1.0))


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("unit", ["2theta", "q", "d"])
def test_patterns_with_mask_range_and_missing_pixels(spark, unit, small, monkeypatch):
    monkeypatch.setattr(powder, "BROADCAST_PIXELS", 1 << 20 if small else 1)
    r = np.random.default_rng(3)
    frames = r.poisson(20, (2, 12, 10)).astype(float) - 2
    frames[1, 3, 4] = np.nan
    mask = np.zeros((12, 10), bool)
    mask[5, :] = True
    tt, chi, solid = angles(GEOMETRY, 12, 10)
    half, wave = np.sin(np.radians(tt) / 2), 12.398419843320026 / 12.0
    axis = {"2theta": tt, "q": 4 * math.pi * half / wave, "d": wave / (2 * half)}[unit]
    c = solid * 0.5 * (1 + np.cos(np.radians(tt)) ** 2 - 0.8 * np.cos(2 * np.radians(chi)) * np.sin(np.radians(tt)) ** 2)
    usable = ~mask & (chi >= -120) & (chi <= 100)
    edges = np.linspace(axis[usable].min(), axis[usable].max(), 6)
    got = powder.integrate(
        cells_of(spark, frames), GEOMETRY, 12, 10, 5, ("k",), unit, chi_range=(-120, 100), polarization_factor=0.8,
        mask=spark.createDataFrame([(5, j, "m") for j in range(10)], "y int, x int, why string"),
    )
    rows = {(r["k"], r["bin"]): (r["x"], r["intensity"], r["sigma"], r["n"]) for r in got.collect()}
    seen = 0
    for k in range(2):
        for b in range(5):
            own = usable & (np.digitize(axis, edges) - 1 == b) & np.isfinite(frames[k])
            if own.any():
                v = frames[k][own]
                want = ((edges[b] + edges[b + 1]) / 2, (v / c[own]).mean(), math.sqrt((np.clip(v, 0, None) / c[own] ** 2).sum()) / own.sum(), own.sum())
                assert rows[k, b] == pytest.approx(want, rel=1e-9)
                seen += 1
    assert seen == len(rows) >= 6
    with pytest.raises(ValueError, match="unit"):
        powder.integrate(cells_of(spark, frames), GEOMETRY, 12, 10, unit="angle")


def test_cake_lines_up_azimuths(spark):
    frames = np.random.default_rng(5).uniform(1, 2, (1, 12, 10))
    tt, chi, solid = angles(GEOMETRY, 12, 10)
    got = {(r["chi_bin"], r["bin"]): (r["chi"], r["intensity"], r["n"]) for r in powder.cake(cells_of(spark, frames), GEOMETRY, 12, 10, 3, 4, x_range=(0.5, 7.5), polarization_factor=None).collect()}
    ring, turn = np.floor((tt - 0.5) / (7 / 3)).astype(int), np.clip(np.floor((chi + 180) / 90), 0, 3).astype(int)
    want = {(a, b): (a * 90 - 135.0, (frames[0] / solid)[(turn == a) & (ring == b)].mean(), ((turn == a) & (ring == b)).sum()) for a, b in set(zip(turn[(ring >= 0) & (ring < 3)].tolist(), ring[(ring >= 0) & (ring < 3)].tolist(), strict=True))}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_spots_are_found_in_noise_and_odd_frames_are_not(spark):
    r = np.random.default_rng(8)
    y, x = (c.reshape(-1).astype(float) for c in np.mgrid[:15, :18])
    want = np.array([[9.0, 6.0, 9.5, 2.0, 1.3, 3.0], [4.0, 11.2, 4.1, 1.1, 2.5, -1.0], [120.0, 8.0, 7.0, 3.0, 2.0, 0.0]])
    frames = spots._model(want, x, y)[0]
    frames[2, 40:60] = np.nan
    noisy = frames + r.normal(0, 0.01, frames.shape)
    rows = [(k, f.tolist()) for k, f in enumerate(frames)] + [(10 + k, f.tolist()) for k, f in enumerate(noisy)] + [(20, None), (21, [1.0, 2.0]), (22, [float("nan")] * 270), (23, [5.0] * 270)]
    got = {r["k"]: r for r in spots.fit_stack(spark.createDataFrame(rows, "k int, pixels array<double>"), ("k",), 15, 18).collect()}
    for k, p in enumerate(want):
        assert got[k]["success"] and [got[k][n] for n in spots.NAMES] == pytest.approx(p, abs=1e-6)
        assert got[10 + k]["success"] and [got[10 + k][n] for n in spots.NAMES] == pytest.approx(p, abs=0.05)
    for k in (20, 21, 22):
        assert not got[k]["success"] and got[k]["x0"] is None
    assert 23 in got
