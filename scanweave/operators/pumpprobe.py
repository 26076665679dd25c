"""Pump-probe events: laser on and off, binning along a scan axis, runs and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.operators.reductions import on_off

V = F.col


def round_even(column: Column, decimals: int) -> Column:
    """Half to even after scaling the double, as array libraries round."""
    scale = float(10**decimals)
    return F.rint(column * scale) / scale


def split_on_off(df: DataFrame, flag: Column, dropna: bool = True) -> DataFrame:
    """Rows with flag 1 or 0, labelled ``laser``; others go, and rows with any null if ``dropna``."""
    out = df.withColumn("laser", on_off(flag, strict=True)).filter(V("laser").isNotNull())
    return out.dropna() if dropna else out


def differential(df: DataFrame, keys: tuple[str, ...], value: str, mode: str = "diff") -> DataFrame:
    """Mean value on and off by ``keys`` side by side, with their difference, ratio or percentage."""
    on, off = (F.avg(F.when(V("laser") == s, V(value))) for s in ("on", "off"))
    both = df.groupBy(*keys).agg(on.alias("on"), off.alias("off"))
    change = {
        "diff": V("on") - V("off"),
        "ratio": F.try_divide("on", "off"),
        "percent": 100 * F.try_divide(V("on") - V("off"), V("off")),
    }[mode]
    return both.withColumn(mode, change)


def bin_by_axis(df: DataFrame, axis: str, values: tuple[str, ...], decimals: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of the members of each rounded axis value; the bin's coordinate is the members' mean axis."""
    at = round_even(V(axis), decimals).alias("bin")
    return df.groupBy(*keys, at).agg(F.avg(axis).alias(axis), *[F.avg(v).alias(v) for v in values], F.count("*").alias("n")).drop("bin")


def combine_runs(runs: list[DataFrame], axis: str, decimals: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs put together on the columns that all have, and binned along the axis."""
    common = [c for c in runs[0].columns if all(c in r.columns for r in runs)]
    out = runs[0].select(*common)
    for r in runs[1:]:
        out = out.unionByName(r.select(*common))
    values = tuple(c for c in common if c != axis and c not in keys)
    return bin_by_axis(out, axis, values, decimals, keys)


def bin_shots(shots: DataFrame, scanvar: str, value_on: str, value_off: str, i0_on: str, i0_off: str) -> DataFrame:
    """Sums of value over monitor by scan value; a pair of shots goes if either monitor is zero."""
    kept = shots.filter((V(i0_on) != 0) & (V(i0_off) != 0))
    return kept.groupBy(scanvar).agg(
        F.sum(V(value_on) / V(i0_on)).alias("on"), F.sum(V(value_off) / V(i0_off)).alias("off"), F.count("*").alias("n_shots"),
        F.sum(i0_on).alias("i0_on"), F.sum(i0_off).alias("i0_off"),
    )


def bin_events(
    events: DataFrame,
    axis: str,
    flag: Column,
    i0: str,
    values: tuple[str, ...],
    bins: int | list[float] | None = None,
    where: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Sums by laser state and bin: ``laser, bin, centre``, each value's sum, the shots and the monitor.

    Shots need a finite axis and monitor, flag 0 or 1, and all ``where`` ranges, which are inclusive.
    ``bins`` is a number of equal bins over the kept range, a list of edges, or none for distinct values;
    the last edge belongs to the last bin.
    """
    kept = events.withColumn("laser", on_off(flag, strict=True)).filter(V("laser").isNotNull())
    for c in (axis, i0):
        kept = kept.filter(V(c).isNotNull() & ~F.isnan(V(c).cast("double")))
    for c, (low, high) in (where or {}).items():
        kept = kept.filter(V(c).between(low, high))
    if bins is None:
        out = kept.groupBy("laser", V(axis).alias("centre"))
    else:
        if isinstance(bins, int):
            low, high = kept.agg(F.min(axis), F.max(axis)).first()
            low, high = (0.0, 1.0) if low is None else (float(low), float(high))
            width = (high - low) / bins or 1.0
            at = F.least(F.floor((V(axis) - low) / width), F.lit(bins - 1)).cast("int")
            centre = F.lit(low) + (V("bin") + 0.5) * width
        else:
            edges = sorted(bins)
            inside = V(axis).between(edges[0], edges[-1])
            kept = kept.filter(inside)
            at = F.lit(len(edges) - 2)
            for k in range(len(edges) - 2, 0, -1):
                at = F.when(V(axis) < edges[k], F.lit(k - 1)).otherwise(at)
            centre = F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:], strict=False)]), V("bin") + 1)
        out = kept.withColumn("bin", at).withColumn("centre", centre).groupBy("laser", "bin", "centre")
    return out.agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("n_shots"), F.sum(i0).alias("sum_i0"))


def linearity(df: DataFrame, detector: str, i0: str, keys: tuple[str, ...] = ("laser",)) -> DataFrame:
    """Slope, intercept, R² and number of points of detector against monitor; null below two points or without variance."""
    return df.groupBy(*keys).agg(
        F.regr_slope(detector, i0).alias("slope"), F.regr_intercept(detector, i0).alias("intercept"), F.regr_r2(detector, i0).alias("r2"),
        F.regr_count(detector, i0).alias("n"),
    )


def reduce_point(shots: DataFrame, point: str, flag: Column, signal: str, i0: str, scalars: tuple[str, ...]) -> DataFrame:
    """Per point: exact medians of the scalars, and mean signal over monitor by laser state of shots with all of them."""
    label, ratio = on_off(flag, strict=True), F.try_divide(V(signal), V(i0))
    full = label.isNotNull() & V(signal).isNotNull() & V(i0).isNotNull()
    means = [F.avg(F.when(full & (label == s), ratio)).alias(f"signal_{s}") for s in ("on", "off")]
    return shots.groupBy(point).agg(*[F.median(c).alias(c) for c in scalars], *means)
