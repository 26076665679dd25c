"""Sums of peaks with planted parameters, and smoothing, backgrounds and peaks of odd curves."""

import numpy as np
import pytest

from scanweave.operators import curves, fitting, scans

X = np.linspace(0, 40, 81)


def fitted(spark, y, **options):
    df = spark.createDataFrame([(1, [float(v) for v in y]), (2, None), (3, [1.0, 2.0])], "k int, y array<double>")
    rows = {r["k"]: r for r in fitting.fit_models(df, "k", X.tolist(), **options).collect()}
    assert not rows[2]["success"] and not rows[3]["success"] and rows[2]["r2"] is None
    return rows[1]


@pytest.mark.parametrize(
    ("shape", "extra"), [("gaussian", ()), ("lorentzian", ()), ("pseudo_voigt", (0.3,)), ("pearson7", (1.7,)), ("step", ())]
)
def test_planted_shape(spark, shape, extra):
    p = np.array([[17.0, 5.0, 40.0, *extra]])
    row = fitted(spark, fitting._peak(shape, X, p)[0] + 3, shapes=(shape,), background="constant")
    assert row["success"] and row["r2"] > 0.999999
    assert [row["p0_centre"], row["p0_fwhm"], row["p0_height"], row["c0"]] == pytest.approx([17, 5, 40, 3], rel=1e-3)


def test_errors_cover_the_truth_and_fixed_stays(spark):
    rng = np.random.default_rng(3)
    y = fitting._peak("gaussian", X, np.array([[17.0, 5.0, 40.0]]))[0] + rng.normal(0, 0.5, len(X))
    row = fitted(spark, y, shapes=("gaussian",), background="none")
    assert 0 < row["p0_centre_err"] < 0.1 and abs(row["p0_centre"] - 17) < 5 * row["p0_centre_err"]
    held = fitted(spark, y, shapes=("gaussian",), background="none", fixed={"p0_fwhm": 5.0})
    assert held["p0_fwhm"] == 5.0 and held["p0_fwhm_err"] == 0.0


def test_unknown_shape(spark):
    with pytest.raises(ValueError):
        fitting.Model(("triangle",), "constant", X)


def curve(spark, ys):
    return spark.createDataFrame([(1, float(i), None if v is None else float(v)) for i, v in enumerate(ys)], "c int, x double, y double")


def test_short_curves(spark):
    df = curve(spark, [1, 5, 2])
    assert [r["smooth"] for r in curves.smooth(df, "savitzky-golay", 5, by=("c",)).collect()] == [None] * 3
    assert [r["smooth"] for r in curves.smooth(df, "median", 3, by=("c",)).orderBy("x").collect()] == [1, 2, 2]
    assert {r["background"] for r in curves.polynomial_background(df, 5, by=("c",)).collect()} == {None}


def test_polynomial_without_key(spark):
    df = curve(spark, [1 + 2 * x + 0.5 * x * x for x in range(12)]).drop("c")
    assert max(abs(r["net"]) for r in curves.polynomial_background(df, 2, ((0, 3), (8, 11))).collect()) < 1e-9


def test_plateau_and_edges(spark):
    rows = curves.prominent_peaks(curve(spark, [9, 1, 4, 4, 4, 0, None, 2, 1, 8]), 5, ("c",)).collect()
    assert [(r["x"], r["height"], r["prominence"]) for r in rows] == [(3.0, 4.0, 3.0), (7.0, 2.0, 1.0)]
    assert curves.prominent_peaks(curve(spark, []), 5, ("c",)).count() == 0


def test_lockstep_takes_nulls_as_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (None, None, 1.0), (3.0, None, 2.0)], "a double, b double, c double")
    assert {r["motor"]: r["leader"] for r in scans.lockstep(df, ("a", "b", "c")).collect()} == {"a": "a", "b": "b", "c": "c"}
    alike = df.filter("c = 1")
    assert {r["motor"]: r["leader"] for r in scans.lockstep(alike, ("b", "a", "c")).collect()} == {"a": "b", "b": "b", "c": "c"}


def test_errors_with_uncertainties_are_absolute(spark):
    rng = np.random.default_rng(5)
    y = fitting._peak("gaussian", X, np.array([[17.0, 5.0, 40.0]]))[0] + rng.normal(0, 0.5, len(X))
    rows = [(k, y.tolist(), [s] * len(X)) for k, s in enumerate((0.5, 1.0))]
    df = spark.createDataFrame(rows, "k int, y array<double>, s array<double>")
    got = {r["k"]: r for r in fitting.fit_models(df, "k", X.tolist(), ("gaussian",), "none", sigma_col="s").collect()}
    for name in ("p0_centre", "p0_fwhm", "p0_height"):
        assert got[1][name] == pytest.approx(got[0][name], rel=1e-6) and got[1][f"{name}_err"] == pytest.approx(2 * got[0][f"{name}_err"], rel=1e-6)
    slopes = [(fitting._peak("gaussian", X, np.array([[17.0 + (k == 0) * 1e-5, 5.0 + (k == 1) * 1e-5, 40.0 + (k == 2) * 1e-5]]))[0] - fitting._peak("gaussian", X, np.array([[17.0, 5.0, 40.0]]))[0]) / 1e-5 for k in range(3)]
    want = np.sqrt(np.diag(np.linalg.inv(np.array(slopes) @ np.array(slopes).T)))
    assert [got[1][f"p0_{n}_err"] for n in ("centre", "fwhm", "height")] == pytest.approx(want, rel=0.02)


@pytest.mark.parametrize(("fwhm", "lorentz"), [(4.0, 1.0), (1.0, 4.0), (3.0, 3.0)])
def test_voigt_is_the_convolution_and_is_found_again(spark, fwhm, lorentz):
    t = np.linspace(-400, 400, 160_001)
    sigma = fwhm / (2 * np.sqrt(2 * np.log(2)))
    bell = np.exp(-0.5 * (t / sigma) ** 2)
    near = np.abs(t) < 8 * sigma
    at = lambda x: (bell[near] / (1 + 4 * ((x - t[near]) / lorentz) ** 2)).sum()
    want = np.array([at(x - 17.3) for x in X]) / at(0.0)
    got = fitting._peak("voigt", X, np.array([[17.3, fwhm, 1.0, lorentz]]))[0]
    np.testing.assert_allclose(got, want, atol=1e-7)
    row = fitted(spark, 30 * got + 2, shapes=("voigt",), background="constant")
    assert [row[f"p0_{n}"] for n in ("centre", "fwhm", "height", "lorentz")] == pytest.approx([17.3, fwhm, 30, lorentz], rel=1e-3)


def test_exponential_background_range_start_and_bounds(spark):
    y = fitting._peak("gaussian", X, np.array([[15.0, 3.0, 20.0]]))[0] + 4 + 9 * np.exp(-(X - 20) / 7)
    row = fitted(spark, y, shapes=("gaussian",), background="exponential")
    assert [row[n] for n in ("p0_centre", "p0_fwhm", "p0_height", "c0", "a", "decay")] == pytest.approx([15, 3, 20, 4, 9, 7], rel=1e-4)
    two = fitting._peak("gaussian", X, np.array([[8.0, 3.0, 20.0]]))[0] + fitting._peak("gaussian", X, np.array([[30.0, 4.0, 60.0]]))[0]
    spoilt = np.where(X > 20, np.nan, two)
    assert fitted(spark, spoilt, shapes=("gaussian",), x_range=(None, 20.0))["p0_centre"] == pytest.approx(8, abs=1e-3)
    assert fitted(spark, two, shapes=("gaussian",), background="none", start={"p0_centre": 8.0, "p0_fwhm": 2.0}, bounds={"p0_centre": (5.0, 12.0)})["p0_centre"] == pytest.approx(8, abs=0.1)
    held = fitted(spark, two, shapes=("gaussian",), background="none", bounds={"p0_fwhm": (None, 2.5)})
    assert held["p0_fwhm"] == pytest.approx(2.5)
    with pytest.raises(ValueError, match="unknown parameters"):
        fitted(spark, two, shapes=("gaussian",), start={"p7_centre": 1.0})


def test_lockstep_with_an_encoder_that_jitters(spark):
    rng = np.random.default_rng(1)
    rows = [(float(k // 5), 3.0 * (k // 5) + rng.uniform(-1e-3, 1e-3), float(k % 5) + rng.uniform(-1e-4, 1e-4), 7.0) for k in range(60)]
    df = spark.createDataFrame(rows, "mu double, encoder double, phi double, energy double")
    assert {r["motor"]: r["leader"] for r in scans.lockstep(df, ("mu", "encoder", "phi", "energy")).collect()} == {"mu": "mu", "encoder": "mu", "phi": "phi", "energy": "energy"}
    assert scans.lockstep(df.limit(0), ("mu", "phi")).count() in (0, 2)
