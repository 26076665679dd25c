"""Powder patterns on a detector that may be tilted: a table of each pixel's angles and corrections, made once and joined by pixel."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions import physics

V = F.col
UNITS = ("2theta", "q", "d")
#: Pixels of a detector whose table is broadcast, some tens of megabytes; a larger one's columns are worked out beside each pixel instead.
BROADCAST_PIXELS = 1 << 20


@dataclass(frozen=True)
class TiltedGeometry:
    """Distance and beam centre, and a tilt about the axis in the detector's plane at ``tilt_plane_deg`` from x."""

    distance_mm: float
    centre_y: float
    centre_x: float
    pixel_um: float
    energy_kev: float
    tilt_deg: float = 0.0
    tilt_plane_deg: float = 0.0

    def rotation(self) -> np.ndarray:
        """The matrix that turns the detector's plane, by Rodrigues' formula."""
        t, p = math.radians(self.tilt_deg), math.radians(self.tilt_plane_deg)
        u, c, s = np.array([math.cos(p), math.sin(p), 0.0]), math.cos(t), math.sin(t)
        cross = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
        return c * np.eye(3) + s * cross + (1 - c) * np.outer(u, u)

    def _place(self) -> tuple[list[Column], Column]:
        m, size = self.rotation().tolist(), self.pixel_um * 1e-3
        x, y = (V("x") - self.centre_x) * size, (V("y") - self.centre_y) * size
        at = [x * m[k][0] + y * m[k][1] + (self.distance_mm if k == 2 else 0.0) for k in range(3)]
        return at, F.sqrt(at[0] * at[0] + at[1] * at[1] + at[2] * at[2])

    def two_theta(self) -> Column:
        at, radius = self._place()
        return F.degrees(F.acos(F.least(F.greatest(at[2] / radius, F.lit(-1.0)), F.lit(1.0))))

    def azimuth(self) -> Column:
        at, _ = self._place()
        return F.degrees(F.atan2(at[1], at[0]))

    def solid_angle(self) -> Column:
        """Relative to a pixel at the same distance that faces the sample."""
        at, radius = self._place()
        normal = self.rotation()[:, 2].tolist()
        facing = F.abs(at[0] * normal[0] + at[1] * normal[1] + at[2] * normal[2]) / radius
        return facing * F.pow(self.distance_mm / radius, F.lit(2))

    def axis(self, unit: str = "2theta") -> Column:
        """A pixel's angle, scattering vector (1/A) or spacing (A); in the beam the spacing is null."""
        if unit not in UNITS:
            raise ValueError(f"unit is one of {UNITS}")
        two_theta = self.two_theta()
        if unit == "2theta":
            return two_theta
        wavelength, half = physics.HC_KEV_A / self.energy_kev, F.sin(F.radians(two_theta) / 2)
        return 4 * math.pi * half / wavelength if unit == "q" else F.lit(wavelength) / F.when(half > 0, 2 * half)


def polarization(two_theta: Column, azimuth: Column, factor: float = 0.0) -> Column:
    """The share of the beam that is scattered; ``factor`` is 0 without polarisation, 1 if it is all horizontal."""
    cos2 = F.pow(F.cos(F.radians(two_theta)), F.lit(2))
    return 0.5 * (1 + cos2 - factor * F.cos(2 * F.radians(azimuth)) * (1 - cos2))


def _columns(geometry: TiltedGeometry, unit: str, solid_angle: bool, factor: float | None) -> dict[str, Column]:
    correction = geometry.solid_angle() if solid_angle else F.lit(1.0)
    if factor is not None:
        correction = correction * polarization(geometry.two_theta(), geometry.azimuth(), factor)
    return {"__axis": geometry.axis(unit), "__chi": geometry.azimuth(), "__c": correction}


def pixel_table(spark: SparkSession, geometry: TiltedGeometry, height: int, width: int) -> DataFrame:
    """``y, x, two_theta, chi, solid_angle`` of every pixel."""
    pixels = spark.range(height * width).select(F.floor(V("id") / width).cast("int").alias("y"), (V("id") % width).cast("int").alias("x"))
    return pixels.select("y", "x", geometry.two_theta().alias("two_theta"), geometry.azimuth().alias("chi"), geometry.solid_angle().alias("solid_angle"))


def _binned(
    cells: DataFrame, geometry: TiltedGeometry, height: int, width: int, bins: int | None, unit: str, x_range: tuple[float | None, float | None] | None,
    chi_range: tuple[float | None, float | None] | None, mask: DataFrame | None, solid_angle: bool, factor: float | None,
) -> DataFrame:
    """``cells`` with ``__c``, ``__chi``, ``__bin`` and ``__x``, the middle of the bin; those outside the ranges or masked are gone.

    A missing end of the range is that of the usable pixels. Bins are half-open; the top edge is outside.
    """
    n = max(bins or int(math.hypot(height, width) / 2), 2)
    made = _columns(geometry, unit, solid_angle, factor)

    def usable(rows: DataFrame) -> DataFrame:
        if mask is not None:
            rows = rows.join(mask.select("y", "x").distinct(), ["y", "x"], "left_anti")
        rows = rows.withColumns(made)
        if chi_range is None:
            return rows
        low, high = (d if v is None else v for v, d in zip(chi_range, (-180.0, 180.0), strict=True))
        return rows.filter((V("__chi") >= low) & (V("__chi") <= high))

    pixels = usable(pixel_table(cells.sparkSession, geometry, height, width).select("y", "x"))
    ends = zip(("__low", "__high"), x_range or (None, None), (F.min, F.max), strict=True)
    row = F.broadcast(pixels.agg(*[(f("__axis") if v is None else F.lit(float(v))).alias(k) for k, v, f in ends]))  # one row

    def placed(rows: DataFrame) -> DataFrame:
        step = (V("__high") - V("__low")) / n
        at = F.least(F.floor((V("__axis") - V("__low")) / step).cast("int"), F.lit(n - 1))
        inside = rows.crossJoin(row).filter("__axis >= __low AND __axis < __high")
        return inside.withColumn("__bin", at).withColumn("__x", V("__low") + (V("__bin") + 0.5) * step).drop("__low", "__high", "__axis")

    own = cells.filter(V("v").isNotNull() & ~F.isnan("v"))
    if height * width <= BROADCAST_PIXELS:
        return own.join(F.broadcast(placed(pixels)), ["y", "x"])
    return placed(usable(own))


def integrate(
    cells: DataFrame, geometry: TiltedGeometry, height: int, width: int, bins: int | None = None, by: tuple[str, ...] = (), unit: str = "2theta",
    x_range: tuple[float | None, float | None] | None = None, chi_range: tuple[float | None, float | None] | None = None, mask: DataFrame | None = None,
    solid_angle: bool = True, polarization_factor: float | None = 0.0,
) -> DataFrame:
    """``by, bin, x, intensity, sigma, n``: the mean corrected value in rings of equal ``unit`` of each frame, all on the same bins.

    ``sigma`` is that of counted photons. ``mask(y, x)`` lists pixels to leave out; ``polarization_factor`` of None corrects for none.
    """
    inside = _binned(cells, geometry, height, width, bins, unit, x_range, chi_range, mask, solid_angle, polarization_factor)
    variance = F.sum(F.greatest("v", F.lit(0.0)) / (V("__c") * V("__c")))
    return inside.groupBy(*by, V("__bin").alias("bin")).agg(
        F.first("__x").alias("x"), F.avg(V("v") / V("__c")).alias("intensity"), (F.sqrt(variance) / F.count("*")).alias("sigma"), F.count("*").alias("n")
    )


def cake(
    cells: DataFrame, geometry: TiltedGeometry, height: int, width: int, bins: int | None = None, chi_bins: int = 180, by: tuple[str, ...] = (), unit: str = "2theta",
    x_range: tuple[float | None, float | None] | None = None, mask: DataFrame | None = None, solid_angle: bool = True, polarization_factor: float | None = 0.0,
) -> DataFrame:
    """``by, chi_bin, bin, chi, x, intensity, n``: the mean corrected value by azimuth and ring."""
    inside = _binned(cells, geometry, height, width, bins, unit, x_range, None, mask, solid_angle, polarization_factor)
    step = 360.0 / chi_bins
    chi = F.least(F.greatest(F.floor((V("__chi") + 180.0) / step).cast("int"), F.lit(0)), F.lit(chi_bins - 1))
    rows = inside.groupBy(*by, chi.alias("chi_bin"), V("__bin").alias("bin")).agg(F.first("__x").alias("x"), F.avg(V("v") / V("__c")).alias("intensity"), F.count("*").alias("n"))
    return rows.select(*by, "chi_bin", "bin", ((V("chi_bin") + 0.5) * step - 180.0).alias("chi"), "x", "intensity", "n")
