"""Elementwise processing of values with uncertainty, and of axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions import physics
from scanweave.operators.curves import interpolate_onto

V = F.col


def apply_function(df: DataFrame, function: str, value: str = "value", sigma: str = "sigma") -> DataFrame:
    """log10, ln, exp, sqrt, square, abs, reciprocal or negate, with first-order uncertainty; null outside the domain."""
    v, s = V(value), V(sigma)
    positive = F.when(v > 0, v)
    made: dict[str, tuple[Column, Column]] = {
        "log10": (F.log10(positive), s / (positive * 2.302585092994046)),
        "ln": (F.ln(positive), s / positive),
        "exp": (F.exp(v), F.exp(v) * s),
        "sqrt": (F.when(v >= 0, F.sqrt(v)), s / (2 * F.sqrt(positive))),
        "square": (v * v, 2 * F.abs(v) * s),
        "abs": (F.abs(v), s),
        "reciprocal": (F.try_divide(F.lit(1.0), v), F.try_divide(s, v * v)),
        "negate": (-v, s),
    }
    out, error = made[function]
    return df.withColumns({value: out, sigma: F.abs(error)})


def normalize(df: DataFrame, value: str, by: str = "max", keys: tuple[str, ...] = (), to: float = 1.0, monitor: str | None = None) -> DataFrame:
    """Values over their maximum, range, mean or sum, or over a monitor relative to its mean; null where the divisor is zero."""
    w = Window.partitionBy(*keys)
    v = V(value)
    if by == "range":
        low, high = F.min(value).over(w), F.max(value).over(w)
        return df.withColumn(value, F.try_divide(v - low, high - low) * to)
    divisor = {
        "max": lambda: F.max(value).over(w), "mean": lambda: F.avg(value).over(w), "sum": lambda: F.sum(value).over(w),
        "monitor": lambda: V(monitor) / F.avg(monitor).over(w),
    }[by]()
    return df.withColumn(value, F.try_divide(v, divisor) * to)


def clip_values(df: DataFrame, value: str, low: float | None = None, high: float | None = None, replace: float | None = None) -> DataFrame:
    """Values clamped to a range, or replaced outside it."""
    v = V(value)
    below, above = (F.lit(False) if b is None else c for b, c in ((low, v < F.lit(low)), (high, v > F.lit(high))))
    if replace is not None:
        return df.withColumn(value, F.when(below | above, F.lit(replace)).otherwise(v))
    return df.withColumn(value, F.when(below, F.lit(low)).when(above, F.lit(high)).otherwise(v))


def replace_missing(df: DataFrame, value: str, by: float = 0.0, sigma: str | None = None) -> DataFrame:
    """Nulls and NaN replaced; a missing uncertainty becomes zero."""
    filled = lambda c, x: F.coalesce(F.when(~F.isnan(c), V(c)), F.lit(float(x)))
    out = df.withColumn(value, filled(value, by))
    return out.withColumn(sigma, filled(sigma, 0.0)) if sigma else out


def threshold_floor(df: DataFrame, value: str, percentile: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Values below a percentile of all become it."""
    floor = df.groupBy(*keys).agg(F.percentile(value, percentile / 100).alias("__f"))
    joined = df.join(floor, list(keys)) if keys else df.crossJoin(F.broadcast(floor))
    return joined.withColumn(value, F.greatest(value, "__f")).drop("__f")


def log_scale(value: Column) -> Column:
    return F.log10(1 + F.greatest(value, F.lit(0.0)))


def clip_nonpositive(value: Column, eps: float = 1e-4) -> Column:
    return F.when(value <= 0, F.lit(eps)).otherwise(value)


def box_mean(cells: DataFrame, box: tuple[int, int, int, int], frame: str = "frame_id", robust: bool = False) -> DataFrame:
    """Mean of a pixel box per frame; if robust, values above the 90th percentile become the median, then those below the 10th the new median."""
    y0, y1, x0, x1 = box
    own = cells.filter((V("y") >= y0) & (V("y") < y1) & (V("x") >= x0) & (V("x") < x1))
    if robust:
        for share, beyond in ((0.9, lambda v, p: v > p), (0.1, lambda v, p: v < p)):
            limits = own.groupBy(frame).agg(F.percentile("v", share).alias("__p"), F.median("v").alias("__m"))
            own = own.join(limits, frame).withColumn("v", F.when(beyond(V("v"), V("__p")), V("__m")).otherwise(V("v"))).drop("__p", "__m")
    return own.groupBy(frame).agg(F.avg("v").alias("mean"))


def normalize_box(cells: DataFrame, box: tuple[int, int, int, int], frame: str = "frame_id", robust: bool = False) -> DataFrame:
    """Cells divided by their frame's mean in the box; null where that is zero. Only one row a frame meets the cells."""
    mean = box_mean(cells, box, frame, robust).withColumnRenamed("mean", "__mean")
    return cells.join(mean, frame).withColumn("v", F.try_divide("v", "__mean")).drop("__mean")


def resample(curve: DataFrame, points: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Each curve interpolated on so many even points of its own range."""
    extent = curve.groupBy(*by).agg(F.min("x").alias("__a"), F.max("x").alias("__b"))
    at = extent.select(*by, "__a", "__b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__i"))
    last = V("__i") == points - 1
    x = F.when(last, V("__b")).otherwise(V("__a") + (V("__b") - V("__a")) * V("__i") / (points - 1))
    return interpolate_onto(curve, at.select(*by, x.alias("x")), by)


def shift_axis(df: DataFrame, dim: str, offset: float = 0.0, scale: float = 1.0, name: str | None = None) -> DataFrame:
    return df.withColumn(dim, V(dim) * scale + offset).withColumnRenamed(dim, name or dim)


def convert_axis(x: Column, source: str, to: str, energy_kev: float) -> Column:
    """An axis among two_theta, theta, q and d."""
    two_theta = {
        "two_theta": lambda: x, "theta": lambda: 2 * x, "q": lambda: physics.two_theta_from_q(x, energy_kev), "d": lambda: physics.two_theta(x, energy_kev),
    }[source]()
    return {
        "two_theta": lambda: two_theta, "theta": lambda: two_theta / 2, "q": lambda: physics.q_from_two_theta(two_theta, energy_kev),
        "d": lambda: physics.d_spacing(two_theta, energy_kev),
    }[to]()


def edge_strength(image: DataFrame, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """``edge``: the Sobel magnitude of pixels whose eight neighbours exist, from windows along rows and then columns."""
    row = Window.partitionBy(*by, "y").orderBy("x")
    a, b = F.lag(value).over(row), F.lead(value).over(row)
    along = image.withColumn("__d", b - a).withColumn("__s", a + 2 * V(value) + b)
    down = Window.partitionBy(*by, "x").orderBy("y")
    gx = F.lag("__d").over(down) + 2 * V("__d") + F.lead("__d").over(down)
    gy = F.lead("__s").over(down) - F.lag("__s").over(down)
    return along.withColumn("edge", F.hypot(gx, gy)).drop("__d", "__s")


def smoothness(image: DataFrame, value: str = "v", size: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """``local_std``: population deviation of the neighbourhood of each pixel."""
    r = size // 2
    steps = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    near = image.select(*by, V("y").alias("__y"), V("x").alias("__x"), V(value).alias("__v"), F.inline(F.array(*steps)))
    near = near.select(*by, (V("__y") + V("dy")).alias("y"), (V("__x") + V("dx")).alias("x"), "__v")
    spread = near.groupBy(*by, "y", "x").agg(F.stddev_pop("__v").alias("local_std"))
    return image.join(spread, [*by, "y", "x"])


def integrate_displacement(image: DataFrame, value: str = "v", edge: str = "e", by: tuple[str, ...] = ()) -> DataFrame:
    """``dfdy``: the running sum along y, less its value and that of ``edge`` in the last column of the same row."""
    down = Window.partitionBy(*by, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    row = Window.partitionBy(*by, "y")
    summed = image.withColumn("__sum", F.sum(value).over(down))
    last = F.max_by(V("__sum") + V(edge), V("x")).over(row)
    return summed.withColumn("dfdy", V("__sum") - last).drop("__sum")


def integrate_second(image: DataFrame, ezx: str = "v", eyz: str = "e", by: tuple[str, ...] = ()) -> DataFrame:
    """``f1, f2, f``: running sums of ``ezx`` along y and of ``eyz`` along x, and f1 less its first column plus that of f2."""
    down = Window.partitionBy(*by, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    row = Window.partitionBy(*by, "y")
    summed = image.withColumn("f1", F.sum(ezx).over(down)).withColumn("f2", F.sum(eyz).over(across))
    return summed.withColumn("f", V("f1") + F.min_by(V("f2") - V("f1"), V("x")).over(row))
