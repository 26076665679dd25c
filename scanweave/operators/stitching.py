"""Curves and frames of neighbouring ranges joined into one, by scale factors or by offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.operators.curves import gap_groups, interpolate_onto

V = F.col
#: Points nearer than this part of a stitched curve's extent are one point. Fixed value.
SAME = 1e-9


def curve_factors(curves: DataFrame, curve: str, by: tuple[str, ...], scale: bool = True) -> DataFrame:
    """``by, curve, first, last, reach, next_first, factor``: a row for each curve of a group, which is one key of ``by``.

    Curves come in the order of their first x. ``reach`` is the furthest x of the curves before, ``next_first`` the first x of the
    next one. A curve is scaled to the one before it that reaches furthest (its reference): by the mean of the
    reference, interpolated at the curve's points within the reference's range, over the mean of these points. Factors
    multiply along the references. Without shared points, or with a mean of zero, a curve stays as it is.
    """
    ends = curves.groupBy(*by, curve).agg(F.min("x").alias("first"), F.max("x").alias("last"))
    w = Window.partitionBy(*by).orderBy("first", curve)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = ends.withColumns({
        "place": F.row_number().over(w),
        "reach": F.max("last").over(before),
        "next_first": F.lead("first").over(w),
        "reference": F.max_by(curve, F.struct("last", "first")).over(before),
    })
    if not scale:
        return own.select(*by, curve, "first", "last", "reach", "next_first", F.lit(1.0).alias("factor"))
    kept = [V(c) for c in by]
    pairs = own.filter("reference IS NOT NULL").select(*kept, V(curve).alias("__of"), V("reference").alias(curve), "reach")
    shared = curves.join(pairs.select(*by, V("__of").alias(curve), "reach"), [*by, curve]).filter("x <= reach")
    reference = curves.join(pairs.select(*by, curve, "__of"), [*by, curve]).select(*by, V("__of").alias(curve), "x", "y")
    at = interpolate_onto(reference, shared.select(*by, curve, "x"), (*by, curve)).filter("y IS NOT NULL AND NOT isnan(y)")
    met = shared.select(*by, curve, "x", V("y").alias("__y")).join(at.distinct(), [*by, curve, "x"])
    ratio = F.when((F.avg("__y") != 0) & F.avg("__y").isNotNull(), F.avg("y") / F.avg("__y"))
    ratios = met.groupBy(*by, curve).agg(ratio.alias("ratio"))
    listed = own.join(ratios, [*by, curve], "left")
    places = listed.select(*by, V(curve).alias("reference"), V("place").alias("__at"))
    linked = listed.join(places, [*by, "reference"], "left")
    chain = F.array_sort(F.collect_list(F.struct("place", "ratio", "__at")))
    step = lambda done, c: F.array_append(done, F.coalesce(c["ratio"] * F.get(done, c["__at"] - 1), F.lit(1.0)))
    factors = linked.groupBy(*by).agg(F.aggregate(chain, F.array().cast("array<double>"), step).alias("__f"))  # one number a curve
    joined = own.join(factors, list(by)) if by else own.crossJoin(F.broadcast(factors))
    return joined.select(*by, curve, "first", "last", "reach", "next_first", F.element_at("__f", V("place")).alias("factor"))


def stitch(curves: DataFrame, curve: str, by: tuple[str, ...], scale: bool = True, overlap: str = "average", tolerance: float | None = None) -> DataFrame:
    """``by, x, y`` and ``sigma``, if there: one curve for each key of ``by`` from its curves ``(by, curve, x, y)``.

    Where curves overlap, ``overlap`` keeps the points of all (``average``: points within the tolerance, by default a
    1e-9 part of the extent, become their mean), of the ``first`` curve or of the ``last``. Points without x or y go first.
    """
    if overlap not in ("average", "first", "last"):
        raise ValueError(f"overlap is average, first or last, not {overlap!r}")
    own = curves.filter(V("x").isNotNull() & ~F.isnan("x") & V("y").isNotNull())
    joined = own.join(curve_factors(own, curve, by, scale), [*by, curve])
    if overlap == "first":
        joined = joined.filter("reach IS NULL OR x > reach")
    elif overlap == "last":
        joined = joined.filter("next_first IS NULL OR x < next_first")
    scaled = [(V("y") * V("factor")).alias("y")]
    if "sigma" in own.columns:
        scaled.append((V("sigma") * F.abs("factor")).alias("sigma"))
    extent = F.max("last").over(Window.partitionBy(*by)) - F.min("first").over(Window.partitionBy(*by))
    within = F.lit(tolerance) if tolerance is not None else SAME * F.greatest(extent, F.lit(1.0))
    rows = joined.withColumn("__tol", within).select(*by, "x", "__tol", *scaled)
    means = [F.avg("x").alias("x"), F.avg("y").alias("y")]
    if "sigma" in own.columns:
        means.append((F.sqrt(F.sum(V("sigma") * V("sigma"))) / F.count("*")).alias("sigma"))
    return gap_groups(rows, "x", V("__tol"), by, "__group").groupBy(*by, "__group").agg(*means).drop("__group")


def overlap_by_axis(points: DataFrame, scan: str, index: str, axis: str, tolerance: float | None = None) -> DataFrame:
    """``scan, offset``: where each scan begins on the first scan's grid, in samples, counted from the earliest.

    The step is the median of the first scan's steps, 1 if it has one point. With a ``tolerance``, a start further than it from
    the grid is an error.
    """
    starts = points.groupBy(scan).agg(F.min_by(axis, index).alias("start"))
    first = points.agg(F.min(scan).alias(scan))
    own = points.join(F.broadcast(first), scan, "left_semi")
    steps = own.withColumn("d", V(axis) - F.lag(axis).over(Window.partitionBy(scan).orderBy(index)))
    origin = steps.agg(F.min_by(axis, index).alias("origin"), F.coalesce(F.median("d"), F.lit(1.0)).alias("step"))
    at = starts.crossJoin(F.broadcast(origin)).withColumn("at", (V("start") - V("origin")) / V("step"))  # one row
    offset = F.bround("at").cast("long")
    if tolerance is not None:
        off = F.abs(V("at") - F.bround("at")) * F.abs("step") > tolerance
        offset = F.when(off, F.raise_error(F.concat(F.lit("not on the grid of the first scan: "), V("start").cast("string"))).cast("long")).otherwise(offset)
    placed = at.select(scan, offset.alias("offset"))
    least = placed.agg(F.min("offset").alias("least"))
    return placed.crossJoin(F.broadcast(least)).select(scan, (V("offset") - V("least")).alias("offset"))  # one row


def stitch_along_axis(frames: DataFrame, offsets: DataFrame, scan: str, index: str, mode: str = "max", fill: float | None = None) -> DataFrame:
    """``index, y, x, v``: the scans' frames ``(scan, index, y, x, v)`` from their offsets on, combined where scans overlap.

    ``max``, ``sum`` and ``mean`` go by pixel; ``brightest`` keeps at each index the frame of the largest sum, of equals that of
    the least scan. With ``fill``, indices between that no scan covers get that value at every pixel.
    """
    if mode not in ("max", "sum", "mean", "brightest"):
        raise ValueError(f"mode is max, sum, mean or brightest, not {mode!r}")
    placed = frames.join(offsets.select(scan, "offset"), scan).withColumn(index, V(index) + V("offset")).drop("offset")
    if mode == "brightest":
        totals = placed.groupBy(index, scan).agg(F.sum("v").alias("total"))
        best = totals.groupBy(index).agg(F.max_by(scan, F.struct("total", (-V(scan)).alias("s"))).alias(scan))
        out = placed.join(best, [index, scan], "left_semi").select(index, "y", "x", "v")
    else:
        out = placed.groupBy(index, "y", "x").agg({"max": F.max, "sum": F.sum, "mean": F.avg}[mode]("v").alias("v"))
    if fill is None:
        return out
    ends = placed.agg(F.min(index).alias("a"), F.max(index).alias("b"))
    free = ends.select(F.explode(F.sequence("a", "b")).alias(index)).join(placed.select(index).distinct(), index, "left_anti")
    pixels = placed.select("y", "x").distinct()
    return out.unionByName(free.join(pixels, how="cross").select(index, "y", "x", F.lit(float(fill)).alias("v")))  # the rows that are asked for


def stack_layers(layers: DataFrame, offsets: DataFrame, layer: str, height: int, width: int) -> DataFrame:
    """``layer, y, x, v``: each layer's content moved by whole pixels ``dy, dx`` within a canvas of the same size; what is uncovered has no row."""
    moved = layers.join(offsets.select(layer, "dy", "dx"), layer, "left")
    at = [(V(c) + F.coalesce(f"d{c}", F.lit(0))).cast("int").alias(c) for c in "yx"]
    return moved.select(layer, *at, "v").filter((V("y") >= 0) & (V("y") < height) & (V("x") >= 0) & (V("x") < width))


def on_canvas(image: DataFrame, height: int, width: int, fill: float) -> DataFrame:
    """``y, x, v`` of a whole image of that size, ``fill`` where ``image`` has no row."""
    full = image.sparkSession.range(height * width).select(F.floor(V("id") / width).cast("int").alias("y"), (V("id") % width).cast("int").alias("x"))
    return full.join(image.select("y", "x", "v"), ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(float(fill))).alias("v"))
