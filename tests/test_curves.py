"""Numbering without a key, fringes of known thickness, the error function."""

import math
import random

import numpy as np
import pytest

from scanweave.functions import physics
from scanweave.operators import curves, scattering


def test_gap_groups_across_ranges(spark):
    r = random.Random(3)
    values = sorted({round(r.uniform(0, 5000), 2) for _ in range(700)})
    got = {x["v"]: x["group"] for x in curves.gap_groups(spark.createDataFrame([(v,) for v in values], "v double"), "v", 9.0).collect()}
    want, group = {}, 0
    for before, v in zip([values[0], *values], values, strict=False):
        group += v - before > 9.0
        want[v] = group
    assert got == want
    assert curves.gap_groups(spark.createDataFrame([], "v double"), "v", 1.0).count() == 0


@pytest.mark.parametrize("thickness", [180.0, 420.0])
def test_kiessig_thickness_of_planted_fringes(spark, thickness):
    q = np.linspace(0.05, 0.35, 240)
    rows = [("film", float(x), float(x**-4 * (1 + 0.3 * math.cos(x * thickness)))) for x in q]
    rows += [("short", 0.1 * k, 1.0) for k in range(5)]
    got = {r["film"]: r["thickness"] for r in scattering.kiessig_thickness(spark.createDataFrame(rows, "film string, q double, r double"), ("film",)).collect()}
    assert abs(got["film"] - thickness) < 0.03 * thickness and (got["short"] is None or math.isnan(got["short"]))


def test_erf_and_footprint(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-30, 31)], "x double")
    assert all(abs(r["e"] - math.erf(r["x"])) < 2e-7 for r in df.select("x", physics.erf(df.x).alias("e")).collect())
    share = [r[0] for r in df.filter("x > 0").select(physics.footprint(df.x, 0.1, 20.0)).collect()]
    assert share == sorted(share) and 0 < share[0] < share[-1] <= 1
