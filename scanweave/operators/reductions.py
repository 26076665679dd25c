"""Reductions of cells: many aggregates in one pass, with partial sums before the shuffle.

``reduce`` runs accumulators that share their group keys as one aggregation.
The other functions are the single reductions; each is one group-by.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V = F.col
HOW: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop, "median": F.median, "count": F.count,
}


@dataclass(frozen=True)
class Accumulator:
    """Named aggregate columns over some group keys."""

    name: str
    keys: tuple[str, ...]
    columns: tuple[Column, ...]


ACCUMULATORS: dict[str, Callable[..., Accumulator]] = {}


def register_accumulator(name: str, replace: bool = False) -> Callable:
    """Adds a maker of accumulators under a name; a name is not overwritten silently."""

    def add(make: Callable[..., Accumulator]) -> Callable[..., Accumulator]:
        if name in ACCUMULATORS and not replace:
            raise KeyError(f"accumulator {name!r} is already registered")
        ACCUMULATORS[name] = make
        return make

    return add


def _image(name: str, how: str) -> None:
    @register_accumulator(name)
    def make(keys: tuple[str, ...] = ("y", "x"), value: str = "v") -> Accumulator:
        return Accumulator(name, keys, (HOW[how](V(value)).alias(name),))


for _name in ("sum", "mean", "max", "min", "std", "median"):
    _image(_name, _name)


@register_accumulator("argmax_motor")
def argmax_motor(axis: str, keys: tuple[str, ...] = ("y", "x"), frame: str = "frame_id", value: str = "v") -> Accumulator:
    """Motor value of the brightest frame, the earliest on a tie, and its value."""
    best = F.max_by(V(axis), F.struct(V(value), -V(frame)))
    return Accumulator("argmax_motor", keys, (best.alias("argmax"), F.max(value).alias("peak")))


@register_accumulator("motor_com")
def motor_com(axis: str, origin: float = 0.0, keys: tuple[str, ...] = ("y", "x"), value: str = "v", clip: float = 1e-10) -> Accumulator:
    """Sums for the weighted mean and width of a motor; weights have the floor ``clip`` and positions are taken from ``origin``."""
    w, m = F.greatest(V(value), F.lit(clip)), V(axis) - F.lit(origin)
    columns = tuple(F.sum(w * F.pow(m, F.lit(k))).alias(f"s{k}") for k in range(5))
    return Accumulator("motor_com", keys, columns)


def reduce(cells: DataFrame, accumulators: list[Accumulator]) -> dict[tuple[str, ...], DataFrame]:
    """One aggregation, and so one pass, for all accumulators with the same keys."""
    by: dict[tuple[str, ...], list[Column]] = {}
    for a in accumulators:
        by.setdefault(a.keys, []).extend(a.columns)
    return {keys: cells.groupBy(*keys).agg(*columns) for keys, columns in by.items()}


def com_from_sums(sums: DataFrame, origin: float = 0.0, clip: float = 1e-10, keep: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """``com, width, skew, kurtosis, total`` from the sums of ``motor_com``."""
    total = F.greatest("s0", F.lit(clip))
    m1, m2, m3, m4 = (V(f"s{k}") / total for k in (1, 2, 3, 4))
    variance = F.greatest(m2 - m1 * m1, F.lit(0.0))
    width = F.sqrt(variance)
    skew = (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / F.greatest(F.pow(width, F.lit(3)), F.lit(1e-30))
    kurtosis = (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, F.lit(4))) / F.greatest(variance * variance, F.lit(1e-30)) - 3
    return sums.select(
        *keep, (m1 + F.lit(origin)).alias("com"), width.alias("width"), skew.alias("skew"), kurtosis.alias("kurtosis"), V("s0").alias("total")
    )


def com_map(cells: DataFrame, axis: str, origin: float = 0.0, keys: tuple[str, ...] = ("y", "x"), clip: float = 1e-10) -> DataFrame:
    """Centre of mass, width, skewness and excess kurtosis of a motor, over any keys."""
    return com_from_sums(reduce(cells, [motor_com(axis, origin, keys, clip=clip)])[keys], origin, clip, keys)


def energy_com(cells: DataFrame, dim: str = "energy", keys: tuple[str, ...] = ("y", "x"), clip: float = 1e-10) -> DataFrame:
    """Centre and width over energy; negative values count as zero and pixels without intensity are null."""
    w = F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0))
    sums = cells.groupBy(*keys).agg(*[F.sum(w * F.pow(V(dim), F.lit(k))).alias(f"s{k}") for k in range(3)])
    com, valid = V("s1") / V("s0"), V("s0") > clip
    width = F.sqrt(F.greatest(V("s2") / V("s0") - com * com, F.lit(0.0)))
    return sums.select(*keys, F.when(valid, com).alias("com"), F.when(valid, width).alias("width"), V("s0").alias("total"))


def central_moments(cells: DataFrame, axis: str, keys: tuple[str, ...] = ("y", "x"), clip: float | None = 1e-10) -> DataFrame:
    """com, std, fwhm, skew, excess kurtosis and total, about the mean itself in a second aggregation."""
    w = V("v") if clip is None else F.greatest("v", F.lit(clip))
    mean = cells.groupBy(*keys).agg((F.sum(w * V(axis)) / F.sum(w)).alias("com"), F.sum(w).alias("total"))
    d = V(axis) - V("com")
    high = cells.join(mean, list(keys)).groupBy(*keys, "com", "total").agg(*[F.sum(w * F.pow(d, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])
    m2, m3, m4 = (V(f"m{k}") / V("total") for k in (2, 3, 4))
    std = F.sqrt(m2)
    return high.select(
        *keys, "com", std.alias("std"), (std * 2.3548200450309493).alias("fwhm"), F.try_divide(m3, F.pow(std, F.lit(3))).alias("skew"),
        (F.try_divide(m4, m2 * m2) - 3).alias("kurtosis"), "total",
    )


def weighted_quantile(cells: DataFrame, axis: str, weight: str, q: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """First motor value whose running weight reaches ``q`` of the total; weights are summed by motor value before the window."""
    sums = cells.groupBy(*keys, axis).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    running = sums.withColumn("run", F.sum("w").over(w.orderBy(axis))).withColumn("all", F.sum("w").over(w))
    return running.filter(V("run") >= q * V("all")).groupBy(*keys).agg(F.min(axis).alias("quantile"))


def prominent(maps: DataFrame, rise: str, fraction: float) -> DataFrame:
    """Rows with a positive rise of at least ``fraction`` of the largest."""
    top = maps.agg(F.max(rise).alias("__top"))
    return maps.crossJoin(F.broadcast(top)).filter((V(rise) > 0) & (V(rise) >= fraction * V("__top"))).drop("__top")


def frame_stats(cells: DataFrame, frame: str = "frame_id", value: Column | None = None) -> DataFrame:
    """Sum, mean, max and centre of each frame; the centre's denominator has the floor 1e-30."""
    v = V("v") if value is None else value
    total = F.greatest(F.sum(v), F.lit(1e-30))
    return cells.groupBy(frame).agg(
        F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.max(v).alias("max"),
        (F.sum(v * V("y")) / total).alias("com_y"), (F.sum(v * V("x")) / total).alias("com_x"),
    )


def frame_moments(cells: DataFrame, frame: str = "frame_id", orders: tuple[int, ...] = (2, 3), value: Column | None = None) -> DataFrame:
    """Central moments of each frame about its centre of mass; frames without intensity are null."""
    v = V("v") if value is None else value
    own = cells.withColumn("__v", v)
    total = F.nullif(F.sum("__v"), F.lit(0.0))
    centre = own.groupBy(frame).agg(
        *[(F.sum(V("__v") * V(d)) / total).alias(f"com_{d}") for d in ("y", "x")], F.sum("__v").alias("total"), F.max("__v").alias("max")
    )
    terms = [
        (F.sum(V("__v") * F.pow(V(d) - V(f"com_{d}"), F.lit(n))) / F.nullif(F.sum("__v"), F.lit(0.0))).alias(f"m{n}_{d}")
        for n in orders for d in ("y", "x")
    ]
    return own.join(centre, frame).groupBy(frame, "com_y", "com_x", "total", "max").agg(*terms)


def histogram(df: DataFrame, column: str, bins: int = 256, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin, low, n, sigma``: counts of finite values in equal bins, the last one closed; without a range, that of all the data."""
    finite = df.select(V(column).cast("double").alias("v")).filter(V("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    if low is None or high is None:
        found = finite.agg(F.min("v"), F.max("v")).first()
        low, high = (found[0] if low is None else low), (found[1] if high is None else high)
    if low is None or high is None:
        return finite.groupBy(F.lit(0).alias("bin")).agg(F.lit(0.0).alias("low"), F.count("*").alias("n"), F.lit(0.0).alias("sigma"))
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((V("v") - low) / width), F.lit(bins - 1)).cast("int")
    counts = finite.filter((V("v") >= low) & (V("v") <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.lit(low) + V("bin") * width).alias("low"), "n", F.sqrt("n").alias("sigma"))


def reduce_dims(cells: DataFrame, kept: tuple[str, ...], how: str = "sum", value: str = "v") -> DataFrame:
    """One aggregate over all dimensions but ``kept``, with the number of values; nulls are skipped, a sum of none is zero."""
    out = HOW[how](V(value))
    out = F.coalesce(out, F.lit(0.0)) if how == "sum" else out
    return cells.groupBy(*kept).agg(out.alias(how), F.count(value).alias("n"))


def projections(cells: DataFrame, motors: tuple[str, ...], value: str = "v") -> DataFrame:
    """The image, each motor by rows and by columns, each pair of motors and the grid, from one shuffle of grouping sets."""
    sets = [("y", "x"), *((m, p) for m in motors for p in ("y", "x")), *combinations(motors, 2)]
    if len(motors) > 2:
        sets.append(motors)
    dims = (*motors, "y", "x")
    return cells.groupingSets([list(map(V, s)) for s in sets], *map(V, dims)).agg(
        F.grouping_id(*dims).alias("grouping"), F.sum(value).alias("sum"), F.count(value).alias("n")
    )


def rois_table(df: DataFrame, rois: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """A table of named pixel regions (y0, y1, x0, x1), half-open, from literals."""
    rows = F.array(*[F.struct(F.lit(n).alias("roi"), *[F.lit(int(b)).alias(k) for k, b in zip(("y0", "y1", "x0", "x1"), box, strict=True)]) for n, box in rois.items()])
    return df.sparkSession.range(1).select(F.inline(rows))


def per_roi(cells: DataFrame, rois: dict[str, tuple[int, int, int, int]], by: tuple[str, ...], columns: tuple[Column, ...]) -> DataFrame:
    """Any aggregates by region and ``by``, all regions in one pass; the list of regions is small and broadcast."""
    table = rois_table(cells, rois)
    inside = (V("y") >= V("y0")) & (V("y") < V("y1")) & (V("x") >= V("x0")) & (V("x") < V("x1"))
    return cells.join(F.broadcast(table), inside).groupBy("roi", *by).agg(*columns)


def roi_integral(cells: DataFrame, rois: dict[str, tuple[int, int, int, int]], by: tuple[str, ...], method: str = "sum") -> DataFrame:
    """Sum, mean or maximum of each region at each point of the grid."""
    return per_roi(cells, rois, by, (HOW[method](V("v")).alias(method), F.count("v").alias("pixels")))


def roi_statistics(cells: DataFrame, rois: dict[str, tuple[int, int, int, int]], by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels, sum, mean, deviation, extremes and centroid of each region."""
    total = F.nullif(F.sum("v"), F.lit(0.0))
    return per_roi(cells, rois, by, (
        F.count("v").alias("pixels"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(V("v") * V("y")) / total).alias("centre_y"), (F.sum(V("v") * V("x")) / total).alias("centre_x"),
    ))


def roi_curves(cells: DataFrame, rois: dict[str, tuple[int, int, int, int]], background: tuple[int, int, int, int], by: tuple[str, ...]) -> DataFrame:
    """Region sums less the background region's mean per pixel, with the Poisson uncertainty."""
    box = "__background"
    sums = roi_integral(cells, {**rois, box: background}, by)
    back = sums.filter(V("roi") == box).select(*by, V("sum").alias("b"), V("pixels").alias("nb"))
    scale = V("pixels") / V("nb")
    joined = sums.filter(V("roi") != box).join(back, list(by))
    value = V("sum") - scale * V("b")
    return joined.select("roi", *by, value.alias("value"), F.sqrt(F.abs("sum") + scale * scale * F.abs("b")).alias("sigma"))


def on_off(flag: Column, strict: bool = False) -> Column:
    """``on`` for 1; otherwise ``off``, or null for what is neither 0 nor 1 if ``strict``."""
    off = F.when(flag == 0, F.lit("off")) if strict else F.lit("off")
    return F.when(flag == 1, F.lit("on")).otherwise(off)


def on_off_split(df: DataFrame, flag: Column, keys: tuple[str, ...], columns: tuple[Column, ...]) -> DataFrame:
    """Any aggregates separately for the laser on and everything else."""
    return df.groupBy(on_off(flag).alias("laser"), *keys).agg(*columns)


def stat_images(cells: DataFrame, axis: str, keys: tuple[str, ...] = ("y", "x"), frame: str = "frame_id") -> DataFrame:
    """Mean, population deviation, and the motor of the frame closest to the mean, the earliest on a tie."""
    mean = cells.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    nearest = F.min_by(V(axis), F.struct(F.abs(V("v") - V("mean")), V(frame)))
    return cells.join(mean, list(keys)).groupBy(*keys, "mean", "std").agg(nearest.alias("nearest"))


def rocking_curve_stats(cells: DataFrame, frame: str = "frame_id", low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Percentile limits of each frame, and mean and sum of what lies between them."""
    limits = cells.groupBy(frame).agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).alias("p"))
    joined = cells.join(limits, frame).filter((V("v") >= V("p")[0]) & (V("v") <= V("p")[1]))
    return joined.groupBy(frame).agg(F.min(V("p")[0]).alias("low"), F.max(V("p")[1]).alias("high"), F.avg("v").alias("mean"), F.sum("v").alias("sum"))


def brightest(cells: DataFrame, frame: str = "frame_id", n: int = 1) -> DataFrame:
    """The frames with the largest totals, the first on ties."""
    totals = cells.groupBy(frame).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
    return totals.orderBy(F.desc("total"), frame).limit(n)


def cluster_stats(df: DataFrame, label: str, value: str) -> DataFrame:
    """Mean, deviation, median, extremes and count by label."""
    return df.groupBy(label).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.count(value).alias("n"),
    )
