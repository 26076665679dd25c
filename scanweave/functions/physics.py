"""Columns of X-ray physics: energy, wavelength, Bragg angles, lattices, scattering geometry, sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: H c in keV times angstrom, and the elementary charge in coulomb.
HC_KEV_A = 12.398419843320026
ELEMENTARY_CHARGE = 1.602176634e-19


def _c(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def wavelength(energy_kev: Column | float) -> Column:
    """Angstrom from keV."""
    return F.try_divide(F.lit(HC_KEV_A), _c(energy_kev))


def energy(wavelength_a: Column | float) -> Column:
    """keV from angstrom."""
    return F.try_divide(F.lit(HC_KEV_A), _c(wavelength_a))


def two_theta(d_a: Column | float, energy_kev: Column | float) -> Column:
    """Degrees; null beyond reach of the wavelength."""
    s = wavelength(energy_kev) / (2 * _c(d_a))
    return F.when(s <= 1, F.degrees(2 * F.asin(s)))


def d_spacing(two_theta_deg: Column | float, energy_kev: Column | float) -> Column:
    return F.try_divide(wavelength(energy_kev), 2 * F.sin(F.radians(_c(two_theta_deg)) / 2))


def q_from_two_theta(two_theta_deg: Column | float, energy_kev: Column | float) -> Column:
    """Inverse angstrom."""
    return 4 * math.pi * F.sin(F.radians(_c(two_theta_deg)) / 2) / wavelength(energy_kev)


def two_theta_from_q(q: Column | float, energy_kev: Column | float) -> Column:
    s = _c(q) * wavelength(energy_kev) / (4 * math.pi)
    return F.when(F.abs(s) <= 1, F.degrees(2 * F.asin(s)))


def scherrer_size(fwhm_deg: Column, two_theta_deg: Column, energy_kev: float, shape: float = 0.9, instrumental_deg: float = 0.0) -> Column:
    """Crystallite size in angstrom; null where the instrument explains all the width."""
    width2 = F.radians(fwhm_deg) * F.radians(fwhm_deg) - math.radians(instrumental_deg) ** 2
    return F.when(width2 > 0, shape * wavelength(energy_kev) / (F.sqrt(width2) * F.cos(F.radians(two_theta_deg) / 2)))


def photons(pulse_uj: Column | float, energy_kev: Column | float) -> Column:
    """Photons in a pulse of so many microjoule."""
    return _c(pulse_uj) * 1e-6 / (_c(energy_kev) * 1e3 * ELEMENTARY_CHARGE)


def transmission(thickness_um: Column, attenuation_length_um: Column) -> Column:
    return F.exp(-thickness_um / attenuation_length_um)


def pixel_angles(dx_mm: Column, dy_mm: Column, distance_mm: float) -> tuple[Column, Column]:
    """In-plane and out-of-plane angles, in degrees, of a place on a flat detector."""
    return F.degrees(F.atan2(dx_mm, F.lit(distance_mm))), F.degrees(F.atan2(dy_mm, F.hypot(dx_mm, F.lit(distance_mm))))


def erf(x: Column) -> Column:
    """The error function by a rational approximation, within 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    series = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - series * F.exp(-x * x))


def footprint(angle_deg: Column, beam_mm: float, sample_mm: float, profile: str = "gaussian") -> Column:
    """Share of the beam that falls on the sample at a grazing angle; ``beam_mm`` is a Gaussian's full width at half maximum or a box's height."""
    length = F.sin(F.radians(angle_deg)) * sample_mm
    if profile == "rectangular":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), length / beam_mm))
    if profile != "gaussian":
        raise ValueError(f"unknown profile {profile!r}")
    return erf(length * math.sqrt(math.log(2)) / beam_mm)


def wavevector(energy_kev: Column | float) -> Column:
    """2 pi over the wavelength, per angstrom."""
    return _c(energy_kev) * (2 * math.pi / HC_KEV_A)


def mono_angle(energy_kev: Column | float, d_a: float = 3.1356) -> Column:
    """The Bragg angle in degrees of a monochromator; null beyond reach of the wavelength."""
    ratio = F.try_divide(F.lit(HC_KEV_A / (2 * d_a)), _c(energy_kev))
    return F.when(F.abs(ratio) <= 1, F.degrees(F.asin(ratio)))


def fwhm_of_sigma(sigma: Column | float) -> Column:
    return _c(sigma) * (2 * math.sqrt(2 * math.log(2)))


def sigma_of_fwhm(fwhm: Column | float) -> Column:
    return _c(fwhm) / (2 * math.sqrt(2 * math.log(2)))


def allowed(h: Column, k: Column, l: Column, centering: str) -> Column:  # noqa: E741
    """The reflection condition of a lattice centering; remainders are never negative."""
    even = lambda c: F.pmod(c, F.lit(2)) == 0
    return {
        "P": F.lit(True), "I": even(h + k + l), "A": even(k + l), "B": even(h + l), "C": even(h + k),
        "F": even(h + k) & even(k + l), "R": F.pmod(-h + k + l, F.lit(3)) == 0,
    }[centering]


def inverse_metric(a, b, c, alpha, beta, gamma) -> tuple:
    """The six entries 11, 22, 33, 23, 13, 12 of the reciprocal metric of a cell, of numbers or of columns."""
    column = isinstance(a, Column)
    ca, cb, cg = (F.cos(F.radians(x)) if column else math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    g = [[a * a, a * b * cg, a * c * cb], [a * b * cg, b * b, b * c * ca], [a * c * cb, b * c * ca, c * c]]
    det = (
        g[0][0] * (g[1][1] * g[2][2] - g[1][2] ** 2) - g[0][1] * (g[0][1] * g[2][2] - g[1][2] * g[0][2]) + g[0][2] * (g[0][1] * g[1][2] - g[1][1] * g[0][2])
    )
    return (
        (g[1][1] * g[2][2] - g[1][2] ** 2) / det, (g[0][0] * g[2][2] - g[0][2] ** 2) / det, (g[0][0] * g[1][1] - g[0][1] ** 2) / det,
        (g[0][1] * g[0][2] - g[0][0] * g[1][2]) / det, (g[0][1] * g[1][2] - g[0][2] * g[1][1]) / det, (g[0][2] * g[1][2] - g[0][1] * g[2][2]) / det,
    )


def inverse_d2(h: Column, k: Column, l: Column, metric: tuple) -> Column:  # noqa: E741
    """1/d² of indices in a cell of this reciprocal metric."""
    m = metric
    return h * h * m[0] + k * k * m[1] + l * l * m[2] + 2 * k * l * m[3] + 2 * h * l * m[4] + 2 * h * k * m[5]


def reflections(crystals: DataFrame, by: tuple[str, ...], centering: str, max_index: int) -> DataFrame:
    """``by, h, k, l, d, two_theta`` of the allowed reflections within reach of each crystal, one of each Friedel pair.

    A crystal is a row ``by, a, b, c, alpha, beta, gamma, energy`` in Angstrom, degrees and keV. Its reciprocal
    metric is worked out once, before its indices are spread over rows; nothing is shuffled.
    """
    n = 2 * max_index + 1
    metric = inverse_metric(*map(F.col, ("a", "b", "c", "alpha", "beta", "gamma")))
    each = crystals.select(*by, "energy", *[m.alias(f"m{j}") for j, m in enumerate(metric)])
    # places beyond the middle one, the origin, in the cube of indices hold one of each Friedel pair
    index = each.withColumn("id", F.explode(F.sequence(F.lit(n**3 // 2 + 1), F.lit(n**3 - 1))))
    spread = index.withColumns({i: F.expr(f"int(id div {n**p} % {n} - {max_index})").cast("long") for i, p in (("h", 2), ("k", 1), ("l", 0))})
    h, k, l = (F.col(i) for i in "hkl")  # noqa: E741
    inverse = inverse_d2(h, k, l, tuple(F.col(f"m{j}") for j in range(6)))
    found = spread.filter(allowed(h, k, l, centering)).withColumn("d", 1 / F.sqrt(inverse))
    return found.select(*by, "h", "k", "l", "d", two_theta(F.col("d"), F.col("energy")).alias("two_theta")).filter("two_theta IS NOT NULL")


def mass_attenuation(energy_kev: Column | float, table: list[tuple[float, float]]) -> Column:
    """cm²/g between the entries (eV, cm²/g) of a material's table, straight in the logarithms of both; the end values beyond it.

    At an absorption edge, two entries of one energy, the upper one holds.
    """
    ordered = sorted((e for e in table), key=lambda e: e[0])
    xs, ys = (F.lit([math.log(e[i]) for e in ordered]) for i in (0, 1))
    u = F.log(_c(energy_kev) * 1e3)
    n = len(ordered)
    at = F.size(F.filter(xs, lambda x: x <= u))
    low, high = F.greatest(at, F.lit(1)), F.least(at + 1, F.lit(n))
    a, b = F.element_at(xs, low), F.element_at(xs, high)
    share = F.when((at < 1) | (at >= n), 0.0).otherwise(F.try_divide(u - a, b - a))
    return F.when(energy_kev.isNotNull() if isinstance(energy_kev, Column) else F.lit(True), F.exp(F.element_at(ys, low) + share * (F.element_at(ys, high) - F.element_at(ys, low))))


def attenuation_length(energy_kev: Column | float, table: list[tuple[float, float]], density: Column | float) -> Column:
    """Micrometres after which the intensity has fallen to 1/e, for a density in g/cm³."""
    return F.try_divide(F.lit(1e4), mass_attenuation(energy_kev, table) * _c(density))


def energy_grid(beams: DataFrame, by: tuple[str, ...], n: int = 21, spectrum: str = "gaussian") -> DataFrame:
    """``by, energy, weight`` for each beam ``by, e0, fwhm``: a Gaussian over three sigma either side, or flat over its full width.

    The ``n`` trapezoid weights have the sum one; they depend on the place in the grid alone.
    """
    reach = {"gaussian": 3 * sigma_of_fwhm(F.col("fwhm")), "flat": F.col("fwhm") / 2}[spectrum]
    steps = [2 * k / (n - 1) - 1 for k in range(n)]
    heights = [math.exp(-0.5 * (3 * u) ** 2) if spectrum == "gaussian" else 1.0 for u in steps]
    ends = [h * (0.5 if k in (0, n - 1) else 1.0) for k, h in enumerate(heights)]
    grid = F.arrays_zip(F.lit(steps).alias("u"), F.lit([w / sum(ends) for w in ends]).alias("w"))
    spread = beams.select(*by, "e0", reach.alias("reach"), F.inline(grid).alias("u", "w"))
    return spread.select(*by, (F.col("e0") + F.col("u") * F.col("reach")).alias("energy"), F.col("w").alias("weight"))
