"""Images and maps: neighbours, gradients, hot pixels, peak maps, strain, colour."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V = F.col


def kam(image: DataFrame, value: str, size: int = 3, by: tuple[str, ...] = (), second: str | None = None) -> DataFrame:
    """Mean misorientation to the neighbours of each pixel, itself excluded, missing ones skipped."""
    r = size // 2
    steps = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy or dx]
    columns = [c for c in (value, second) if c]
    near = image.select(*by, "y", "x", *[V(c).alias(f"__{c}") for c in columns], F.inline(F.array(*steps)))
    near = near.select(*by, (V("y") + V("dy")).alias("y"), (V("x") + V("dx")).alias("x"), *[f"__{c}" for c in columns])
    joined = image.join(near, [*by, "y", "x"])
    deltas = [V(c) - V(f"__{c}") for c in columns]
    distance = F.abs(deltas[0]) if len(deltas) == 1 else F.hypot(*deltas)
    return joined.groupBy(*by, "y", "x").agg(F.avg(distance).alias("kam"))


def gradients(image: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``dy, dx``: central differences inside, one-sided at the edges."""

    def along(dim: str, other: str) -> Column:
        w = Window.partitionBy(*by, other).orderBy(dim)
        a, b = F.lag(value).over(w), F.lead(value).over(w)
        return F.when(F.lag(dim).over(w).isNull(), b - V(value)).when(F.lead(dim).over(w).isNull(), V(value) - a).otherwise((b - a) / 2)

    return image.withColumn("dy", along("y", "x")).withColumn("dx", along("x", "y"))


def remove_hot_pixels(image: DataFrame, height: int, width: int, threshold: float = 8.0, size: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels far above the median of their neighbourhood become it; edges repeat the nearest pixel."""
    r = size // 2
    steps = [F.struct(F.lit(dy).alias("sy"), F.lit(dx).alias("sx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    wanted = image.select(*by, "y", "x", F.inline(F.array(*steps)))
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    wanted = wanted.select(*by, V("y").alias("y0"), V("x").alias("x0"), clip(V("y") + V("sy"), height).alias("y"), clip(V("x") + V("sx"), width).alias("x"))
    med = wanted.join(image, [*by, "y", "x"]).groupBy(*by, V("y0").alias("y"), V("x0").alias("x")).agg(F.median("v").alias("med"))
    joined = image.join(med, [*by, "y", "x"])
    spread = joined.groupBy(*by).agg(F.median(F.abs(V("v") - V("med"))).alias("mad"))
    full = joined.join(spread, list(by)) if by else joined.crossJoin(F.broadcast(spread))
    noise = 1.4826 * V("mad") + F.sqrt(F.abs("med")) + 1e-12
    hot = V("v") - V("med") > threshold * noise
    return full.select(*by, "y", "x", F.when(hot, V("med")).otherwise(V("v")).alias("v"), hot.alias("hot"))


def gaussian_peak_maps(cells: DataFrame, axis: str, threshold: float = 0.1, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """``centre, sigma, amplitude`` of a Gaussian along ``axis`` per pixel: a weighted parabola through log v in closed form."""
    top = cells.groupBy(*keys).agg(F.max("v").alias("__top"), F.avg(axis).alias("__mean"))
    used = cells.join(top, list(keys)).filter((V("v") > threshold * V("__top")) & (V("v") > 0))
    d, w, z = V(axis) - V("__mean"), V("v") * V("v"), F.ln("v")
    sums = used.groupBy(*keys, "__mean").agg(
        *[F.sum(w * F.pow(d, F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(w * z * F.pow(d, F.lit(k))).alias(f"t{k}") for k in range(3)], F.count("*").alias("n")
    )
    s, t = [V(f"s{k}") for k in range(5)], [V(f"t{k}") for k in range(3)]

    def det(m: list[list[Column]]) -> Column:
        return (
            m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
        )

    rows = [[s[i + j] for j in range(3)] for i in range(3)]
    whole = det(rows)
    solved = [F.try_divide(det([[t[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]), whole) for k in range(3)]
    fitted = sums.select(*keys, "__mean", "n", *[c.alias(n) for c, n in zip(solved, ("a", "b", "c"), strict=True)])
    ok = (V("c") < 0) & (V("n") >= 3)
    return fitted.select(
        *keys, F.when(ok, V("__mean") - V("b") / (2 * V("c"))).alias("centre"), F.when(ok, F.sqrt(-1 / (2 * V("c")))).alias("sigma"),
        F.when(ok, F.exp(V("a") - V("b") * V("b") / (4 * V("c")))).alias("amplitude"),
    )


def strain_map(image: DataFrame, value: str, theta_deg: float | None = None, kind: str = "theta") -> DataFrame:
    """``strain`` of an angle or energy map against its median."""
    reference = image.agg(F.median(value).alias("__ref"))
    joined = image.crossJoin(F.broadcast(reference))
    d = V(value) - V("__ref")
    if kind == "energy":
        strain = -F.try_divide(d, V("__ref"))
    else:
        theta = F.lit(math.tan(math.radians(theta_deg))) if theta_deg is not None else F.tan(F.radians(V("__ref") * (0.5 if kind == "two_theta" else 1.0)))
        strain = -F.radians(d * (0.5 if kind == "two_theta" else 1.0)) / theta
    return joined.withColumn("strain", strain).drop("__ref")


def vector_field(maps: DataFrame, a: str, b: str) -> DataFrame:
    """``angle, magnitude`` of two maps less their medians."""
    centre = maps.agg(F.median(a).alias("__a"), F.median(b).alias("__b"))
    u, v = V(a) - V("__a"), V(b) - V("__b")
    return maps.crossJoin(F.broadcast(centre)).withColumn("angle", F.atan2(v, u)).withColumn("magnitude", F.hypot(u, v)).drop("__a", "__b")


def equalize_histogram(image: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks in place of values, from 0 to 1; ties follow by position."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy("v", "y", "x"))
    return image.withColumn("v", (rank - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1)))


def transform(image: DataFrame, how: str, height: int, width: int) -> DataFrame:
    """Flips, the transpose and quarter turns of an image by index arithmetic."""
    y, x = V("y"), V("x")
    at = {
        "flip_y": (height - 1 - y, x), "flip_x": (y, width - 1 - x), "transpose": (x, y), "rot180": (height - 1 - y, width - 1 - x),
        "rot90": (width - 1 - x, y), "rot270": (x, height - 1 - y),
    }[how]
    return image.select(*[c for c in image.columns if c not in ("y", "x")], at[0].alias("y"), at[1].alias("x"))


def mask_pixels(image: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values outside the range become null."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (V("v") >= low)
    if high is not None:
        inside = inside & (V("v") <= high)
    return image.withColumn("v", F.when(inside, V("v")))


def subtract_dark(image: DataFrame, dark: DataFrame, scale: float = 1.0, clip: bool = False) -> DataFrame:
    v = V("v") - scale * V("__d")
    return image.join(dark.select("y", "x", V("v").alias("__d")), ["y", "x"]).withColumn("v", F.greatest(v, F.lit(0.0)) if clip else v).drop("__d")


def flat_field(image: DataFrame, flat: DataFrame, minimum: float = 0.05) -> DataFrame:
    """Values over the flat relative to its mean; null where the flat is too small."""
    mean = flat.agg(F.avg("v").alias("__m"))
    relative = flat.crossJoin(F.broadcast(mean)).select("y", "x", (V("v") / V("__m")).alias("__f"))
    return image.join(relative, ["y", "x"]).withColumn("v", F.when(V("__f") > minimum, V("v") / V("__f"))).drop("__f")


def compatibility(image: DataFrame, eyz: str, ezx: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``eyz_py, eyz_px, ezx_py, ezx_px`` and ``dev2nd``, half of ezx_py less eyz_px; differences as in ``gradients``."""
    one = gradients(image, eyz, by).withColumnsRenamed({"dy": "eyz_py", "dx": "eyz_px"})
    both = gradients(one, ezx, by).withColumnsRenamed({"dy": "ezx_py", "dx": "ezx_px"})
    return both.withColumn("dev2nd", (V("ezx_py") - V("eyz_px")) / 2)


def hsv_to_rgb(hue: Column, saturation: Column, brightness: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 1; the hue is a share of the circle and wraps."""
    sector = lambda n: F.pmod(n + hue * 6, F.lit(6.0))
    fall = lambda k: F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
    return tuple(brightness - brightness * saturation * fall(sector(F.lit(float(n)))) for n in (5, 3, 1))


def orientation_rgb(
    image: DataFrame, a: str, b: str, by: tuple[str, ...], centre: tuple[float, float] | None = None, span: float | None = None, intensity: str | None = None
) -> DataFrame:
    """``red, green, blue`` from 0 to 1: the hue is the direction of a tilt, the saturation its size.

    Tilts are measured from ``centre``, by default the medians of each key of ``by``, and are saturated at ``span``, by default
    their 95th percentile. The brightness follows ``intensity`` between its 1st and 99th percentiles. Pixels without a tilt are black.
    """
    finite = V(a).isNotNull() & V(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    if centre is None:
        middle = image.groupBy(*by).agg(F.median(F.nanvl(a, F.lit(None))).alias("__ca"), F.median(F.nanvl(b, F.lit(None))).alias("__cb"))
        own = image.join(middle, list(by))
    else:
        own = image.withColumns({"__ca": F.lit(float(centre[0])), "__cb": F.lit(float(centre[1]))})
    own = own.withColumns({"__da": F.when(finite, V(a) - V("__ca")), "__db": F.when(finite, V(b) - V("__cb"))}).withColumn("__r", F.hypot("__da", "__db"))
    ends = [F.percentile("__r", F.lit(0.95)).alias("__reach")]
    if intensity is not None:
        ends += [F.percentile(intensity, F.lit(share)).alias(name) for name, share in (("__low", 0.01), ("__high", 0.99))]
    own = own.join(own.groupBy(*by).agg(*ends), list(by))
    reach = F.lit(float(span)) if span is not None else F.when(V("__reach") > 0, V("__reach")).otherwise(1.0)
    bright = F.lit(1.0)
    if intensity is not None:
        width = F.when(V("__high") != V("__low"), V("__high") - V("__low")).otherwise(1.0)
        bright = F.greatest(F.least((V(intensity) - V("__low")) / width, F.lit(1.0)), F.lit(0.0))
    hue = F.pmod(F.atan2("__db", "__da") / (2 * math.pi), F.lit(1.0))
    colours = hsv_to_rgb(hue, F.least(V("__r") / reach, F.lit(1.0)), bright)
    seen = zip(("red", "green", "blue"), colours, strict=True)
    return own.withColumns({n: F.when(V("__r").isNotNull(), c).otherwise(0.0) for n, c in seen}).drop("__ca", "__cb", "__da", "__db", "__r", "__reach", "__low", "__high")


def profile(image: DataFrame, value: str, along: str = "x", roi: tuple[int, int, int, int] | None = None, how: str = "sum", by: tuple[str, ...] = ()) -> DataFrame:
    """``value`` along one axis, summed or averaged over the other inside the region (y0, y1, x0, x1), ends excluded."""
    if roi:
        y0, y1, x0, x1 = roi
        image = image.filter((V("y") >= y0) & (V("y") < y1) & (V("x") >= x0) & (V("x") < x1))
    return image.groupBy(*by, along).agg((F.sum(value) if how == "sum" else F.avg(value)).alias(value))


def line_profile(
    image: DataFrame, value: str, start: tuple[float, float], stop: tuple[float, float], height: int, width: int, across: int = 1, points: int | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """``point, distance, value`` along a straight line between two (y, x), bilinear, averaged over ``across`` parallel lines.

    The weights of the four pixels around each sample make a small table that the line's length bounds; only its pixels are read.
    """
    (y0, x0), (y1, x1) = start, stop
    length = math.hypot(y1 - y0, x1 - x0)
    n = points or max(math.ceil(length) + 1, 2)
    share = np.linspace(0.0, 1.0, n)[:, None]
    aside = (np.arange(across) - (across - 1) / 2) / max(length, 1e-12)
    y = np.clip(y0 + share * (y1 - y0) + aside * (x1 - x0), 0, height - 1)
    x = np.clip(x0 + share * (x1 - x0) - aside * (y1 - y0), 0, width - 1)
    weights: dict[tuple[int, int, int], float] = {}
    for k in range(n):
        for ys, xs in zip(y[k].tolist(), x[k].tolist(), strict=True):
            for cy, cx in product((int(ys), int(ys) + 1), (int(xs), int(xs) + 1)):
                weight = (1 - abs(ys - cy)) * (1 - abs(xs - cx)) / across
                if weight > 0:
                    weights[k, cy, cx] = weights.get((k, cy, cx), 0.0) + weight
    rows = [(k, float(length * share[k, 0]), cy, cx, w) for (k, cy, cx), w in weights.items()]
    near = image.sparkSession.createDataFrame(rows, "point int, distance double, y int, x int, __w double")
    return image.join(F.broadcast(near), ["y", "x"]).groupBy(*by, "point", "distance").agg(F.sum(V(value) * V("__w")).alias(value))
