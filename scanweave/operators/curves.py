"""Curves ``(curve, x, y)``: peaks, derivatives, integrals, smoothing, background, joining.

A curve is the rows of one ``by`` key ordered by x; all functions are windows or
aggregates partitioned by that key, so many curves run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

V = F.col


def _ordered(by: tuple[str, ...], x: str = "x") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(x)


#: Ranges of values that are numbered apart where there is no key.
RANGES = 64


def gap_groups(df: DataFrame, column: str, tolerance: float, by: tuple[str, ...] = (), name: str = "group") -> DataFrame:
    """``df`` with a group number that grows where sorted values are more than ``tolerance`` apart; groups may chain.

    Without a key the values are numbered in ``RANGES`` ranges between approximate quantiles, and a table
    with one row for each range carries gaps and numbers across, so no task sorts all values.
    """
    keys, own = by, df
    if not by:
        bounds = df.approxQuantile(column, [k / RANGES for k in range(1, RANGES)], 1 / (4 * RANGES))
        above = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= V(column))) if bounds else F.lit(0)
        keys, own = ("__range",), df.withColumn("__range", above)
    w = _ordered(keys, column)
    new = F.when(V(column) - F.lag(column).over(w) > tolerance, 1).otherwise(0)
    out = own.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")
    if by:
        return out
    ends = out.groupBy("__range").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.max(name).alias("last"))
    o = Window.orderBy("__range")  # one row for each range
    starts = F.when(V("low") - F.lag("high").over(o) > tolerance, 1).otherwise(0)
    first = F.sum(V("start") + V("before")).over(o.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumns({"start": starts, "before": F.coalesce(F.lag("last").over(o), F.lit(0))}).select("__range", first.alias("__first"))
    joined = out.join(F.broadcast(ends), "__range")
    return joined.withColumn(name, V(name) + V("__first")).drop("__range", "__first")


def cluster_values(df: DataFrame, column: str, tolerance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Centre (mean), extent and size of each gap group of a column's values; equal values are counted before the window."""
    counted = df.filter(V(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    grouped = gap_groups(counted, column, tolerance, by)
    mean = F.sum(V(column) * V("__n")) / F.sum("__n")
    return grouped.groupBy(*by, "group").agg(mean.alias("centre"), F.min(column).alias("low"), F.max(column).alias("high"), F.sum("__n").alias("n"))


def merge_points(curve: DataFrame, tolerance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Points closer than ``tolerance`` to the one before become their mean; ``sigma``, if there, is sqrt(Σσ²)/n."""
    out = [F.avg("x").alias("x"), F.avg("y").alias("y")]
    if "sigma" in curve.columns:
        out.append((F.sqrt(F.sum(V("sigma") * V("sigma"))) / F.count("*")).alias("sigma"))
    return gap_groups(curve, "x", tolerance, by).groupBy(*by, "group").agg(*out).drop("group")


def derivative(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``dy``: second-order differences on uneven points, one-sided at the ends; with a column ``sigma`` also ``dy_sigma``.

    The uncertainty is that of the two points beside each over their distance.
    """
    w = _ordered(by)
    h1, h2 = V("x") - F.lag("x").over(w), F.lead("x").over(w) - V("x")
    before, after = F.lag("y").over(w), F.lead("y").over(w)
    inner = (h1 * h1 * after - h2 * h2 * before + (h2 * h2 - h1 * h1) * V("y")) / (h1 * h2 * (h1 + h2))
    dy = F.when(h1.isNull(), (after - V("y")) / h2).when(h2.isNull(), (V("y") - before) / h1).otherwise(inner)
    if "sigma" not in curve.columns:
        return curve.withColumn("dy", dy)
    own = V("sigma")
    left, right = F.coalesce(F.lag("sigma").over(w), own), F.coalesce(F.lead("sigma").over(w), own)
    apart = F.coalesce(F.lead("x").over(w), V("x")) - F.coalesce(F.lag("x").over(w), V("x"))
    return curve.withColumns({"dy": dy, "dy_sigma": F.try_divide(F.hypot(left, right), apart)})


def cumulative_integral(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``integral``: running trapezoid from the first point; with a column ``sigma`` also ``integral_sigma``, by each point's share of the whole area."""
    w = _ordered(by)
    if "sigma" in curve.columns:
        share = 0.5 * (F.coalesce(F.lead("x").over(w), V("x")) - F.coalesce(F.lag("x").over(w), V("x"))) * V("sigma")
        own = curve.withColumn("__s", share * share)
        curve = own.withColumn("integral_sigma", F.sqrt(F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")
    step = F.coalesce(0.5 * (V("x") - F.lag("x").over(w)) * (V("y") + F.lag("y").over(w)), F.lit(0.0))
    return curve.withColumn("__step", step).withColumn("integral", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def moving_average(curve: DataFrame, half: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``smooth``: mean of ``2 half + 1`` points; beyond the ends the end value counts."""
    w = _ordered(by)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = w.rowsBetween(-half, half)
    rank, n = F.row_number().over(w), F.count("*").over(whole)
    missing_left, missing_right = F.greatest(half + 1 - rank, F.lit(0)), F.greatest(rank + half - n, F.lit(0))
    total = F.sum("y").over(inside) + missing_left * F.first("y").over(whole) + missing_right * F.last("y").over(whole)
    return curve.withColumn("smooth", total / (2 * half + 1))


def peak_position(curve: DataFrame, method: str = "maximum", by: tuple[str, ...] = ()) -> DataFrame:
    """``peak`` of each curve: the maximum, the vertex of the parabola through it, or the centre of mass above half height."""
    top = F.max_by("x", F.struct(V("y"), -V("x")))
    if method == "maximum":
        return curve.groupBy(*by).agg(top.alias("peak"), F.max("y").alias("height"))
    if method == "com":
        w = Window.partitionBy(*by)
        low, high = F.min("y").over(w), F.max("y").over(w)
        own = curve.withColumn("__w", V("y") - low).withColumn("__keep", V("y") - low >= 0.5 * (high - low))
        kept = own.filter("__keep").groupBy(*by)
        return kept.agg(F.coalesce(F.try_divide(F.sum(V("x") * V("__w")), F.sum("__w")), F.avg("x")).alias("peak"), F.max("y").alias("height"))
    if method != "parabola":
        raise ValueError(f"unknown method {method!r}")
    w = _ordered(by)
    near = curve.select(*by, "x", "y", *[f(c).over(w).alias(f"{c}{k}") for c in ("x", "y") for f, k in ((F.lag, 0), (F.lead, 2))])
    best = near.groupBy(*by).agg(F.max_by(F.struct("x", "y", "x0", "x2", "y0", "y2"), F.struct(V("y"), -V("x"))).alias("b"))
    d0, d2 = V("b.x0") - V("b.x"), V("b.x2") - V("b.x")
    e0, e2 = V("b.y0") - V("b.y"), V("b.y2") - V("b.y")
    bottom = d0 * d2 * (d2 - d0)
    curvature, slope = F.try_divide(d0 * e2 - d2 * e0, bottom), F.try_divide(d2 * d2 * e0 - d0 * d0 * e2, bottom)
    vertex = V("b.x") - F.try_divide(slope, 2 * curvature)
    return best.select(*by, F.when(curvature < 0, vertex).otherwise(V("b.x")).alias("peak"), V("b.y").alias("height"))


def fwhm(curve: DataFrame, by: tuple[str, ...] = (), baseline: str = "min") -> DataFrame:
    """``fwhm`` between the interpolated crossings of half height either side of the maximum; null if one is missing."""
    base = F.min("y") if baseline == "min" else F.lit(0.0)
    peak = curve.groupBy(*by).agg(F.max_by("x", F.struct(V("y"), -V("x"))).alias("p"), ((base + F.max("y")) / 2).alias("half"))
    w = _ordered(by)
    near = curve.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w))
    joined = near.join(peak, list(by)) if by else near.crossJoin(F.broadcast(peak))
    cross = V("x") + (V("half") - V("y")) * (V("x2") - V("x")) / F.nullif(V("y2") - V("y"), F.lit(0.0))
    left = F.max(F.when((V("x2") <= V("p")) & (V("y") < V("half")) & (V("y2") >= V("half")), cross))
    right = F.min(F.when((V("x") >= V("p")) & (V("y") >= V("half")) & (V("y2") < V("half")), cross))
    return joined.groupBy(*by).agg((right - left).alias("fwhm"))


def linear_background(curve: DataFrame, by: tuple[str, ...] = (), share: float = 0.1) -> DataFrame:
    """``background`` and ``net``: a straight line fitted to the outer ``share`` of x on either side."""
    w = Window.partitionBy(*by)
    low, high = F.min("x").over(w), F.max("x").over(w)
    edge = (V("x") <= low + share * (high - low)) | (V("x") >= high - share * (high - low))
    own = curve.withColumn("__e", edge)
    fitted = own.filter("__e").groupBy(*by).agg(F.regr_slope("y", "x").alias("__s"), F.regr_intercept("y", "x").alias("__i"))
    joined = curve.join(fitted, list(by)) if by else curve.crossJoin(F.broadcast(fitted))
    line = V("__i") + V("__s") * V("x")
    return joined.withColumn("background", line).withColumn("net", V("y") - line).drop("__s", "__i")


def local_maxima(curve: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` highest points above both neighbours, ``rank`` from 1."""
    w = _ordered(by)
    top = curve.withColumn("__l", F.lag("y").over(w)).withColumn("__r", F.lead("y").over(w)).filter((V("y") > V("__l")) & (V("y") > V("__r")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("y"), "x"))
    return top.withColumn("rank", rank).filter(V("rank") <= n).drop("__l", "__r")


def interpolate_onto(curve: DataFrame, targets: DataFrame, by: tuple[str, ...] = (), method: str = "linear") -> DataFrame:
    """``x, y`` at the targets' x between the curve's neighbours; null outside the curve.

    Both sides go through one window ordered by x, which carries the last point on either side along.
    """
    points = curve.select(*by, "x", F.struct("x", "y").alias("p"), F.lit(0).alias("t"))
    wanted = targets.select(*by, "x", F.lit(None).cast(points.schema["p"].dataType).alias("p"), F.lit(1).alias("t"))
    both = points.unionByName(wanted)
    w = Window.partitionBy(*by)
    before = F.last("p", ignorenulls=True).over(w.orderBy("x", "t").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("p", ignorenulls=True).over(w.orderBy(F.desc("x"), "t").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("a", before).withColumn("b", after).filter("t = 1")
    share = F.coalesce(F.try_divide(V("x") - V("a.x"), V("b.x") - V("a.x")), F.lit(0.0))
    if method == "nearest":
        y = F.when(V("a").isNotNull() & V("b").isNotNull(), F.when(share <= 0.5, V("a.y")).otherwise(V("b.y")))
    else:
        y = V("a.y") + share * (V("b.y") - V("a.y"))
    return near.select(*by, "x", y.alias("y"))


def regrid(values: DataFrame, targets: dict[str, list[float]], dims: tuple[str, ...], by: tuple[str, ...] = (), method: str = "linear") -> DataFrame:
    """``by, dims, value`` of values on a grid ``(by, dims, value)``, interpolated onto the targets of some of its dims; null outside.

    One dimension after another is interpolated along, which on a full grid is the multilinear rule.
    """
    for dim, places in targets.items():
        others = {d: f"__{d}" for d in (*by, *dims) if d != dim}
        rest = tuple(others.values())
        curve = values.select(*[V(d).alias(n) for d, n in others.items()], V(dim).cast("double").alias("x"), V("value").alias("y"))
        wanted = curve.select(*rest).distinct().select(*rest, F.explode(F.array(*[F.lit(float(p)) for p in places])).alias("x"))
        values = interpolate_onto(curve, wanted, rest, method).select(*[V(n).alias(d) for d, n in others.items()], V("x").alias(dim), V("y").alias("value"))
    return values.select(*by, *dims, "value")


def align_peaks(curves: DataFrame, curve: str, target: float | None = None) -> DataFrame:
    """Curves shifted in x so that their maxima fall on ``target``, or on the first curve's."""
    peaks = peak_position(curves, by=(curve,)).select(curve, "peak")
    first = F.min_by("peak", curve) if target is None else F.lit(float(target))
    goal = peaks.agg(first.alias("goal"))
    joined = curves.join(peaks, curve).crossJoin(F.broadcast(goal))
    return joined.withColumn("x", V("x") + V("goal") - V("peak")).drop("peak", "goal")


def stitch_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """The right curve scaled by the mean ratio where both have the same x, and averaged there with the left."""
    shared = left.select("x", V("y").alias("a")).join(right.select("x", V("y").alias("b")), "x")
    factor = shared.agg(F.coalesce(F.try_divide(F.avg("a"), F.avg("b")), F.lit(1.0)).alias("f"))
    scaled = right.crossJoin(F.broadcast(factor)).select("x", (V("y") * V("f")).alias("y"))
    return left.select("x", "y").unionByName(scaled).groupBy("x").agg(F.avg("y").alias("y"))


def _padded(w: WindowSpec, half: int) -> Column:
    """The ``2 half + 1`` values of y around each point; beyond the ends the end value counts."""
    near = F.collect_list("y").over(w.rowsBetween(-half, half))
    left = F.greatest(F.lit(half + 1) - F.row_number().over(w), F.lit(0))
    right = F.lit(2 * half + 1) - left - F.size(near)
    return F.concat(F.array_repeat(F.element_at(near, 1), left), near, F.array_repeat(F.element_at(near, -1), right))


def _dot(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def smooth(curve: DataFrame, method: str = "gaussian", width: float = 2.0, order: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """``smooth``: a Gaussian of ``width`` points cut at four widths, the median of ``width`` points, or Savitzky-Golay.

    Windows are made odd. Beyond the ends the end value counts; Savitzky-Golay fits its polynomial of ``order`` to the
    first or last whole window there, and gives null for curves shorter than one. Values of y must not be null.
    """
    w = _ordered(by)
    if method == "gaussian":
        half = int(4 * width + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / width) ** 2)
        return curve.withColumn("smooth", _dot(_padded(w, half), F.lit((kernel / kernel.sum()).tolist())))
    window = max(round(width), 1)
    window += 1 - window % 2
    if method == "median":
        return curve.withColumn("smooth", F.element_at(F.array_sort(_padded(w, window // 2)), window // 2 + 1))
    if method != "savitzky-golay":
        raise ValueError(f"unknown smoothing {method!r}")
    window = max(window, order + 2 + (order + 3) % 2)
    half = window // 2
    powers = np.vander(np.arange(window) - half, order + 1)
    rows = powers @ np.linalg.pinv(powers)
    at, n = F.row_number().over(w) - 1, F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.least(F.greatest(at - half, F.lit(0)), n - window)
    near = F.collect_list("y").over(w.rowsBetween(1 - window, window - 1))
    values = F.slice(near, (first - F.greatest(at - window + 1, F.lit(0)) + 1).cast("int"), window)
    fitted = _dot(values, F.element_at(F.lit(rows.tolist()), (at - first + 1).cast("int")))
    return curve.withColumn("smooth", F.when(n >= window, fitted))


def polynomial_background(
    curve: DataFrame, degree: int = 2, regions: tuple[tuple[float, float], ...] = (), by: tuple[str, ...] = ()
) -> DataFrame:
    """``background`` and ``net``: a polynomial fitted in the ``regions`` of x, or to the first and last tenth of the points.

    Sums of powers are made by aggregation and solved for whole batches of curves, one row each; curves with too few
    background points give nulls. Degree 0 is the constant.
    """
    if regions:
        chosen = curve.filter(reduce(or_, [V("x").between(min(r), max(r)) for r in regions]))
    else:
        w = _ordered(by)
        at, n = F.row_number().over(w), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        tenth = F.greatest(F.floor(n / 10), F.lit(2))
        chosen = curve.withColumn("__edge", (at <= tenth) | (at > n - tenth)).filter("__edge").drop("__edge")
    chosen = chosen.filter(V("y").isNotNull() & ~F.isnan("y"))
    middle = chosen.groupBy(*by).agg(F.avg("x").alias("__c"))
    u = V("x") - V("__c")
    joined = _joined(chosen, middle, by).withColumn("__u", u)
    power = lambda k: F.pow(F.col("__u"), F.lit(k))
    xs = F.array(*[F.sum(power(k)) for k in range(2 * degree + 1)])
    ys = F.array(*[F.sum(V("y") * power(k)) for k in range(degree + 1)])
    moments = joined.groupBy(*by).agg(F.first("__c").alias("__c"), F.count_distinct("x").alias("__m"), xs.alias("__xs"), ys.alias("__ys"))
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in curve.select(*by).schema]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.add.outer(np.arange(degree + 1), np.arange(degree + 1))
        for batch in batches:
            batch = batch[batch["__m"] > degree]
            if len(batch):
                found = np.linalg.solve(np.stack(batch["__xs"])[:, at], np.stack(batch["__ys"])[..., None])[..., 0]
                yield batch[[*by, "__c"]].assign(__a=list(found))

    fitted = moments.mapInPandas(solve, ", ".join([*keys, "__c double", "__a array<double>"]))
    own = _joined(curve, fitted, by, "left")
    value = F.when(V("__a").isNotNull(), reduce(lambda total, k: total * u + F.element_at("__a", k + 1), range(degree, -1, -1), F.lit(0.0)))
    return own.withColumn("background", value).withColumn("net", V("y") - V("background")).drop("__a", "__c")


def _joined(curve: DataFrame, table: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``curve`` with its row of a table that has one row for each curve."""
    if by:
        return curve.join(table, list(by), how)
    return curve.join(F.broadcast(table), F.lit(True), how)


def _prominent(y: np.ndarray) -> list[tuple[int, float, float]]:
    """Index, prominence and full width at half prominence, in points, of each maximum; a plateau counts at its middle."""
    out = []
    edges = np.flatnonzero(np.diff(y)) + 1
    starts, stops = np.append(0, edges), np.append(edges, len(y)) - 1
    for a, b in zip(starts[1:-1].tolist(), stops[1:-1].tolist(), strict=True):
        if not (y[a - 1] < y[a] > y[b + 1]):
            continue
        at = (a + b) // 2
        higher = np.flatnonzero(y > y[at])
        k = int(np.searchsorted(higher, at))
        low = int(higher[k - 1]) + 1 if k else 0
        high = int(higher[k]) if k < len(higher) else len(y)
        prominence = float(y[at] - max(y[low : at + 1].min(), y[at:high].min()))
        level = y[at] - prominence / 2
        i = at - int(np.argmax(y[low : at + 1][::-1] <= level))
        j = at + int(np.argmax(y[at:high] <= level))
        left = i + (level - y[i]) / (y[i + 1] - y[i]) if y[i] < level else float(i)
        right = j - (level - y[j]) / (y[j - 1] - y[j]) if y[j] < level else float(j)
        out.append((at, prominence, right - left))
    return out


def prominent_peaks(curve: DataFrame, n: int, by: tuple[str, ...], prominence: float = 0.0) -> DataFrame:
    """``x, height, fwhm, prominence`` of the ``n`` most prominent maxima of each curve; null values count as zero.

    The width is taken at half the prominence and measured in median steps of x.
    """
    points = F.array_sort(F.collect_list(F.struct("x", F.coalesce(F.nanvl("y", F.lit(0.0)), F.lit(0.0)).alias("y"))))
    whole = curve.groupBy(*by).agg(points.alias("p")).select(*by, V("p.x").alias("x"), V("p.y").alias("y"))
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in curve.select(*by).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                x, y = (np.asarray(v, dtype=float) for v in row[-2:])
                found = [f for f in _prominent(y) if f[1] >= prominence]
                step = abs(float(np.median(np.diff(x)))) if len(x) > 1 else 1.0
                for at, high, width in sorted(found, key=lambda f: (-f[1], f[0]))[:n]:
                    rows.append((*row[:-2], float(x[at]), float(y[at]), width * step, high))
            yield pd.DataFrame(rows, columns=[*by, "x", "height", "fwhm", "prominence"])

    return whole.mapInPandas(run, ", ".join([*keys, "x double", "height double", "fwhm double", "prominence double"]))


def unit_gaussian(curve: DataFrame, sigma: float, centre: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """``profile``: a Gaussian on each curve's x whose trapezoid area is one; as it is where the area is zero."""
    w = _ordered(by)
    own = curve.withColumn("__g", F.exp(-0.5 * F.pow((V("x") - centre) / sigma, F.lit(2))))
    own = own.withColumn("__t", 0.5 * (V("x") - F.lag("x").over(w)) * (V("__g") + F.lag("__g").over(w)))
    area = F.sum("__t").over(Window.partitionBy(*by))
    return own.withColumn("profile", F.when(area > 0, V("__g") / area).otherwise(V("__g"))).drop("__g", "__t")
