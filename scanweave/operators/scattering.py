"""Powder patterns and reflectivity from cells and a geometry of few parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions import physics

V = F.col


@dataclass(frozen=True)
class Geometry:
    """A flat detector across the beam: distance, beam centre in pixels, pixel size, energy."""

    distance_mm: float
    centre_y: float
    centre_x: float
    pixel_um: float
    energy_kev: float

    def place(self) -> tuple[Column, Column]:
        """Vertical and horizontal distance from the beam in mm."""
        s = self.pixel_um / 1000
        return (V("y") - self.centre_y) * s, (V("x") - self.centre_x) * s

    def two_theta(self) -> Column:
        dy, dx = self.place()
        return F.degrees(F.atan2(F.hypot(dy, dx), F.lit(self.distance_mm)))

    def azimuth(self) -> Column:
        dy, dx = self.place()
        return F.degrees(F.atan2(dy, dx))

    def correction(self, polarization: float = 0.0) -> Column:
        """Solid angle relative to the beam's, times polarisation."""
        dy, dx = self.place()
        cos = F.cos(F.radians(self.two_theta()))
        sin2 = 1 - cos * cos
        share = F.coalesce(F.try_divide(dx * dx - dy * dy, dx * dx + dy * dy), F.lit(0.0))
        return F.pow(cos, F.lit(3)) * (1 - 0.5 * sin2 * (1 + polarization * share) if polarization else F.lit(1.0))


def _range(geometry: Geometry, height: int, width: int) -> tuple[float, float]:
    """The two-theta range of a detector's pixels, from its few extreme places."""

    def at(y: float, x: float) -> float:
        s = geometry.pixel_um / 1000
        r = math.hypot((y - geometry.centre_y) * s, (x - geometry.centre_x) * s)
        return math.degrees(math.atan2(r, geometry.distance_mm))

    nearest = at(min(max(round(geometry.centre_y), 0), height - 1), min(max(round(geometry.centre_x), 0), width - 1))
    return nearest, max(at(y, x) for y in (0, height - 1) for x in (0, width - 1))


def integrate_1d(
    cells: DataFrame, geometry: Geometry, height: int, width: int, bins: int | None = None, by: tuple[str, ...] = (),
    x_range: tuple[float, float] | None = None, solid_angle: bool = True, polarization: float = 0.0,
) -> DataFrame:
    """``bin, two_theta, intensity, sigma, n``: mean corrected value per ring; bins are half-open, the top edge is outside."""
    n = bins or max(2, int(math.hypot(height, width) / 2))
    low, high = x_range or _range(geometry, height, width)
    step = (high - low) / n
    c = geometry.correction(polarization) if solid_angle else F.lit(1.0)
    own = cells.filter(V("v").isNotNull() & ~F.isnan("v")).select(*by, "v", geometry.two_theta().alias("tt"), c.alias("c"))
    inside = own.withColumn("bin", F.floor((V("tt") - low) / step).cast("int")).filter((V("tt") >= low) & (V("tt") < high) & (V("bin") < n))
    return inside.groupBy(*by, "bin").agg(
        F.avg(V("v") / V("c")).alias("intensity"), (F.sqrt(F.sum(F.greatest("v", F.lit(0.0)) / (V("c") * V("c")))) / F.count("*")).alias("sigma"),
        F.count("*").alias("n"),
    ).withColumn("two_theta", F.lit(low) + (V("bin") + 0.5) * step)


def cake(cells: DataFrame, geometry: Geometry, height: int, width: int, bins: int, chi_bins: int = 180, x_range: tuple[float, float] | None = None) -> DataFrame:
    """``chi_bin, bin, intensity, n``: mean value by azimuth and ring."""
    low, high = x_range or _range(geometry, height, width)
    step = (high - low) / bins
    own = cells.filter(V("v").isNotNull() & ~F.isnan("v")).select("v", geometry.two_theta().alias("tt"), geometry.azimuth().alias("chi"))
    at = own.select(
        "v", F.floor((V("chi") + 180) / (360 / chi_bins)).cast("int").alias("chi_bin"), F.floor((V("tt") - low) / step).cast("int").alias("bin")
    )
    inside = at.filter((V("bin") >= 0) & (V("bin") < bins) & (V("chi_bin") < chi_bins))
    return inside.groupBy("chi_bin", "bin").agg(F.avg("v").alias("intensity"), F.count("*").alias("n"))


def calibrate_ring(cells: DataFrame, d_spacing_a: float, energy_kev: float, pixel_um: float, percentile: float = 99.0) -> DataFrame:
    """``centre_y, centre_x, radius, distance_mm, n`` of the circle through the brightest pixels, by its normal equations."""
    limit = cells.agg(F.percentile("v", percentile / 100).alias("__p"))
    used = cells.crossJoin(F.broadcast(limit)).filter(V("v") >= V("__p"))
    y, x = V("y").cast("double"), V("x").cast("double")
    z = x * x + y * y
    names = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "z": z, "xz": x * z, "yz": y * z}
    s = used.agg(*[F.sum(c).alias(k) for k, c in names.items()])
    mx, my, mz = V("x") / V("n"), V("y") / V("n"), V("z") / V("n")
    a, b, c = V("xx") / V("n") - mx * mx, V("xy") / V("n") - mx * my, V("yy") / V("n") - my * my
    d, e = V("xz") / V("n") - mx * mz, V("yz") / V("n") - my * mz
    det = 2 * (a * c - b * b)
    cx, cy = F.try_divide(d * c - e * b, det), F.try_divide(a * e - b * d, det)
    found = s.select(cx.alias("centre_x"), cy.alias("centre_y"), mx.alias("mx"), my.alias("my"), mz.alias("mz"), V("n").cast("long").alias("n"))
    square = V("mz") - 2 * V("centre_x") * V("mx") - 2 * V("centre_y") * V("my") + V("centre_x") * V("centre_x") + V("centre_y") * V("centre_y")
    radius = F.sqrt(square)
    angle = physics.two_theta(d_spacing_a, energy_kev)
    return found.filter("n >= 10").select("centre_y", "centre_x", radius.alias("radius"), (radius * (pixel_um / 1000) / F.tan(F.radians(angle))).alias("distance_mm"), "n")


def reflectivity(curve: DataFrame, energy_kev: float, beam_mm: float, sample_mm: float, i0: float = 1.0, profile: str = "gaussian", by: tuple[str, ...] = ()) -> DataFrame:
    """``by, x, q, r``: intensity over the monitor and the share of the beam on the sample; angles at or below zero are left out."""
    share = physics.footprint(V("x"), beam_mm, sample_mm, profile)
    q = physics.q_from_two_theta(2 * V("x"), energy_kev)
    return curve.filter("x > 0").select(*by, "x", q.alias("q"), (V("y") / i0 / share).alias("r"))


def critical_angle(curves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, x_c``: where the logarithm of each curve ``x, y`` falls fastest, from its maximum on and within its first 60 %.

    The slope is the second-order difference for uneven steps; points without a positive y are left out.
    """
    w = Window.partitionBy(*by).orderBy("x")
    own = curves.filter("x IS NOT NULL AND y > 0").select(*by, "x", F.log10("y").alias("f"))
    own = own.withColumns(
        {"k": F.row_number().over(w) - 1, "hs": V("x") - F.lag("x").over(w), "hd": F.lead("x").over(w) - V("x"), "fs": F.lag("f").over(w), "fd": F.lead("f").over(w)}
    )
    inner = (V("hs") ** 2 * V("fd") + (V("hd") ** 2 - V("hs") ** 2) * V("f") - V("hd") ** 2 * V("fs")) / (V("hs") * V("hd") * (V("hd") + V("hs")))
    slope = F.when(V("hs").isNull(), (V("fd") - V("f")) / V("hd")).when(V("hd").isNull(), (V("f") - V("fs")) / V("hs")).otherwise(inner)
    whole = Window.partitionBy(*by)
    own = own.withColumns({"slope": slope, "n": F.count("*").over(whole), "top": F.max_by("k", F.struct("f", -V("k"))).over(whole)})
    start = F.greatest(V("top"), F.lit(1))
    inside = own.filter((V("k") >= start) & (V("k") < F.greatest(start + 3, F.floor(V("n") * 0.6))))
    return inside.groupBy(*by).agg(F.min_by("x", F.struct("slope", "k")).alias("x_c"))


def kiessig_thickness(curves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, thickness``: a film's thickness in angstrom by the strongest frequency of its fringes ``q, r``.

    log10(r q^4) on four times as many even points, less its Gaussian trend, under a Hann window,
    is Fourier transformed; curves of fewer than 16 usable points have a null thickness.
    """

    def strongest(q: np.ndarray, r: np.ndarray) -> float | None:
        ok = np.isfinite(q) & np.isfinite(r) & (q > 0) & (r > 0)
        order = np.argsort(q[ok], kind="stable")
        q, r = q[ok][order], r[ok][order]
        if len(q) < 16 or q[0] == q[-1]:
            return None
        even = np.linspace(q[0], q[-1], 4 * len(q))
        level = np.interp(even, q, np.log10(r * q**4))
        sigma = len(even) / 8
        reach = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        trend = np.convolve(np.pad(level, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
        size = 8 * len(even)
        power = np.abs(np.fft.rfft((level - trend) * np.hanning(len(even)), n=size))
        length = 2 * math.pi * np.fft.rfftfreq(size, even[1] - even[0])
        power[length <= 2 * math.pi / (q[-1] - q[0])] = 0
        return float(length[np.argmax(power)])

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = strongest(rows["q"].to_numpy(float), rows["r"].to_numpy(float))
        return pd.DataFrame([[*key, found]], columns=[*by, "thickness"])

    own = curves.select(*by, "q", "r")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(by)])
    return own.groupBy(*by).applyInPandas(one, f"{fields}{', ' if by else ''}thickness double")
