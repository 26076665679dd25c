"""The table of scans: selection, groups, what varies, grids and work still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.operators.curves import cluster_values
from scanweave.operators.grids import value_groups

V = F.col
FINISHED = ("complete", "aborted")


def status(started: Column, ended: Column, ok: Column, frames: Column, planned: Column) -> Column:
    """running, empty, aborted or complete, by the first rule that holds."""
    return (
        F.when(~started | ~ended, "running").when(frames == 0, "empty").when(~ok | (frames < planned), "aborted").otherwise("complete")
    )


def select(scans: DataFrame, where: dict[str, object], statuses: tuple[str, ...] | None = FINISHED) -> DataFrame:
    """Scans that match: a value (numbers within 1e-9), a list of values, or an inclusive range as a pair."""
    out = scans.filter(V("status").isin(*statuses)) if statuses else scans
    for column, want in where.items():
        if isinstance(want, tuple):
            low, high = want
            out = out.filter((F.lit(True) if low is None else V(column) >= low) & (F.lit(True) if high is None else V(column) <= high))
        elif isinstance(want, list):
            out = out.filter(V(column).isin(*want))
        elif isinstance(want, (int, float)):
            out = out.filter(F.abs(V(column) - want) <= 1e-9)
        else:
            out = out.filter(V(column) == want)
    return out


def groups(scans: DataFrame, by: tuple[str, ...], *columns: Column) -> DataFrame:
    """Scans by equal values; those without a value are left out."""
    return scans.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias("scans"), *columns)


def varying(scans: DataFrame, columns: dict[str, float]) -> DataFrame:
    """``column, range, values``: the columns that vary by more than their least step, have a value in every scan, and more than one distinct one."""
    stats = [
        F.struct(
            F.lit(c).alias("column"), (F.max(c) - F.min(c)).cast("double").alias("range"), F.count_distinct(V(c)).alias("values"),
            (F.count(c) == F.count("*")).alias("full"), F.lit(float(step)).alias("step"),
        )
        for c, step in columns.items()
    ]
    rows = scans.agg(F.array(*stats).alias("r")).select(F.inline("r"))
    return rows.filter("full AND range >= step AND values > 1").select("column", "range", "values")


def centres(scans: DataFrame, column: str, tolerance: float | None = None) -> DataFrame:
    """The cluster centres of a column's values; by default values within a thousandth of the range are the same."""
    if tolerance is None:
        low, high = scans.agg(F.min(column), F.max(column)).first()
        tolerance = 1e-3 * (float(high) - float(low)) if low is not None and high != low else 1e-6
    return cluster_values(scans, column, tolerance)


def pending(discovered: DataFrame, processed: DataFrame, skipped: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """Keys found, neither processed nor skipped, and among ``only`` if given."""
    out = discovered.select(key).distinct().join(processed, key, "left_anti").join(skipped, key, "left_anti")
    return out.join(only, key, "left_semi") if only is not None else out


def common_grid(points: DataFrame, scan: str, column: str) -> DataFrame:
    """``low, high, step``: the range of all scans and the finest of their median steps."""
    from pyspark.sql import Window

    w = Window.partitionBy(scan).orderBy(column)
    steps = points.select(scan, column).distinct().withColumn("d", V(column) - F.lag(column).over(w))
    per = steps.groupBy(scan).agg(F.median("d").alias("step"), F.min(column).alias("low"), F.max(column).alias("high"))
    return per.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.when(V("step") > 0, V("step"))).alias("step"))


def snake_index(frame: Column, fast: int, snake: bool = True) -> tuple[Column, Column]:
    """Slow and fast indices of a frame number on a raster, every other row backwards if ``snake``."""
    slow, at = F.floor(frame / fast).cast("int"), (frame % fast).cast("int")
    return slow, F.when((slow % 2 == 1) & F.lit(snake), fast - 1 - at).otherwise(at)


#: A motor has moved if its values span more than this, whatever its own least step. Fixed value.
MOVED = 1e-6


def moving(frames: DataFrame, motors: dict[str, float], least: float = MOVED) -> DataFrame:
    """``motor, low, high`` of the recorded motors that moved by more than their least step; missing values don't count."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), V(c))
    own = frames.select(*[V(c).cast("double").alias(c) for c in motors])
    stats = [F.struct(F.lit(c).alias("motor"), F.min(finite(c)).alias("low"), F.max(finite(c)).alias("high"), F.lit(max(step, least)).alias("step")) for c, step in motors.items()]
    return own.agg(F.array(*stats).alias("s")).select(F.inline("s")).filter("high - low > step").select("motor", "low", "high")


def lockstep(frames: DataFrame, motors: tuple[str, ...], tolerance: float | dict[str, float] | None = None) -> DataFrame:
    """``motor, leader``: the first motor, in the given order, that steps together with each: each one's value tells the other's.

    Readbacks jitter, so each motor's values are numbered by their gaps first, by default those wider than a thousandth of its range;
    a missing value is one of its own. Then every motor's numbers are grouped, in one pass, with the extremes of all others' numbers.
    """
    _, lookup = value_groups(frames, motors, tolerance)
    cells = lookup.groupBy("motor", "tol").agg(F.min("cell").alias("first"), F.map_from_entries(F.collect_list(F.struct("cell", "index"))).alias("index"))
    row = cells.agg(*[F.max_by(F.struct("tol", "first", "index"), V("motor") == m).alias(f"__{m}") for m in motors])  # a cell for each half tolerance of the range
    own = frames.select(*[V(m).cast("double").alias(m) for m in motors]).crossJoin(F.broadcast(row))
    number = lambda m: F.coalesce(F.try_element_at(V(f"__{m}.index"), F.floor(V(m) / (V(f"__{m}.tol") / 2))), F.lit(-1))
    numbers = own.select(*[F.when(V(m).isNull() | F.isnan(m), -1).otherwise(number(m)).alias(m) for m in motors]).groupBy(*motors).agg(F.count("*").alias("__n"))
    each = numbers.select(F.explode(F.array(*[F.struct(F.lit(m).alias("motor"), V(m).alias("number")) for m in motors])).alias("e"), *motors).select("e.*", *motors)
    told = each.groupBy("motor", "number").agg(*[(F.min(m) == F.max(m)).alias(m) for m in motors]).groupBy("motor").agg(*[F.bool_and(m).alias(m) for m in motors])
    pairs = told.select("motor", F.explode(F.array_compact(F.array(*[F.when(V(m), F.lit(m)) for m in motors]))).alias("other"))
    back = pairs.select(V("other").alias("motor"), V("motor").alias("other"))
    place = F.array_position(F.lit(list(motors)), V("other"))
    return pairs.join(back, ["motor", "other"]).groupBy("motor").agg(F.min_by("other", place).alias("leader"))


#: Names under which a scan may record how long each point counted. Fixed values.
COUNT_TIMES = ("Seconds", "sec", "count_time", "acq_time", "exposure_time", "integration_time")


def counters(
    points: DataFrame, x: str, channels: tuple[str, ...], by: tuple[str, ...] = (), monitor: str | None = None, monitor_dark: float = 0.0
) -> DataFrame:
    """``by, channel, x, value``: the recorded channels of a scan's points as curves against ``x``.

    ``monitor`` divides the other channels by a channel less ``monitor_dark`` counts a second; points without beam are null.
    Points without x are left out.
    """
    beam = None
    if monitor is not None:
        beam = V(monitor).cast("double")
        if monitor_dark:
            time = next((n for n in COUNT_TIMES if n in points.columns), None)
            if time is None:
                raise ValueError(f"a dark rate needs the count time; the points have none of {COUNT_TIMES}")
            beam = beam - monitor_dark * V(time)
        beam = F.when(beam > 0, beam)
    value = lambda c: V(c).cast("double") if beam is None or c == monitor else V(c) / beam
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), value(c).alias("value")) for c in channels])
    own = points.filter(V(x).isNotNull() & ~F.isnan(V(x).cast("double")))
    return own.select(*by, V(x).cast("double").alias("x"), F.explode(rows).alias("r")).select(*by, "r.channel", "x", "r.value")
