"""Crystal and diffractometer columns: cells, equivalents, rotations, scattering vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions import physics

Vector = tuple[Column, Column, Column]


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    return a * b * c * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)


def crystal_system(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column, tol: float = 1e-3) -> Column:
    """The lattice system of a cell, by equal edges and right angles within ``tol``."""
    eq = lambda x, y: F.abs(x - y) <= tol
    right = eq(alpha, F.lit(90.0)) & eq(beta, F.lit(90.0)) & eq(gamma, F.lit(90.0))
    return (
        F.when(right & eq(a, b) & eq(b, c), "cubic")
        .when(right & eq(a, b), "tetragonal")
        .when(right, "orthorhombic")
        .when(eq(a, b) & eq(alpha, F.lit(90.0)) & eq(beta, F.lit(90.0)) & eq(gamma, F.lit(120.0)), "hexagonal")
        .when(eq(a, b) & eq(b, c) & eq(alpha, beta) & eq(beta, gamma), "trigonal")
        .when(eq(alpha, F.lit(90.0)) & eq(gamma, F.lit(90.0)), "monoclinic")
        .otherwise("triclinic")
    )


def reduce_indices(h: Column, k: Column, l: Column) -> Vector:  # noqa: E741
    """Indices over their greatest common divisor, by Euclid's steps on an array."""

    def gcd(x: Column, y: Column) -> Column:
        pair = F.aggregate(
            F.sequence(F.lit(1), F.lit(64)), F.array(F.abs(x), F.abs(y)),
            lambda p, _: F.when(p[1] == 0, p).otherwise(F.array(p[1], F.pmod(p[0], F.when(p[1] == 0, F.lit(1)).otherwise(p[1])))),
        )
        return pair[0]

    g = F.greatest(gcd(gcd(h, k), l), F.lit(1))
    return tuple((x / g).cast("long") for x in (h, k, l))


def rotated(v: Vector, axis: tuple[float, float, float], angle_deg: Column) -> Vector:
    """A vector turned about an axis by a column of angles."""
    n = math.sqrt(sum(x * x for x in axis))
    u = [x / n for x in axis]
    c, s = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    dot = v[0] * u[0] + v[1] * u[1] + v[2] * u[2]
    cross = (v[2] * u[1] - v[1] * u[2], v[0] * u[2] - v[2] * u[0], v[1] * u[0] - v[0] * u[1])
    return tuple(v[i] * c + cross[i] * s + dot * (1 - c) * u[i] for i in range(3))


def scattering_vector(two_theta_deg: Column, delta_deg: Column, energy_kev: float) -> Vector:
    """k (k_f - k_i) for a beam along x, with z up."""
    k = 2 * math.pi * energy_kev / physics.HC_KEV_A
    t, d = F.radians(two_theta_deg), F.radians(delta_deg)
    return k * (F.cos(d) * F.cos(t) - 1), k * F.cos(d) * F.sin(t), k * F.sin(d)


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


#: Lattice spacings in angstrom of monochromator crystals.
MONO_D = {"Si111": 3.13560, "Si220": 1.92016, "Si311": 1.63751, "Ge111": 3.26627}


def mono_energy(theta_deg: Column, crystal: str = "Si111") -> Column:
    """keV that a monochromator passes at an angle."""
    return physics.HC_KEV_A / (2 * MONO_D[crystal] * F.sin(F.radians(theta_deg)))


def magnification(miscut_rad: Column, bragg_rad: float) -> Column:
    """Beam magnification of an asymmetrically cut crystal."""
    return F.sin(F.lit(bragg_rad) + miscut_rad) / F.sin(F.lit(bragg_rad) - miscut_rad)


def miscut(mag: Column, bragg_rad: float) -> Column:
    return F.atan(math.tan(bragg_rad) * (mag - 1) / (mag + 1))


def families(reflections: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, d`` to six digits with the largest indices as the name, the number of reflections, and the angle."""
    grouped = reflections.groupBy(*by, F.round("d", 6).alias("d")).agg(
        F.max(F.struct("h", "k", "l")).alias("m"), (2 * F.count("*")).alias("multiplicity"), F.min("two_theta").alias("two_theta")
    )
    return grouped.select(*by, "d", F.col("m.h").alias("h"), F.col("m.k").alias("k"), F.col("m.l").alias("l"), "multiplicity", "two_theta")


def mag_split(total: Column, share: Column | float) -> tuple[Column, Column]:
    """The magnifications of a pair of crystals, of which the first takes the power ``share`` of the total."""
    first = F.pow(total, share if isinstance(share, Column) else F.lit(float(share)))
    return first, F.try_divide(total, first)
