"""The grid of a scan from its frames' motor readbacks, and work on its axes.

Readbacks jitter, so values nearer than a tolerance are one grid point. They are
counted in cells of half a tolerance first, in one pass over all motors: only cells, of which
a scan has at most some thousands, are sorted, and every frame finds its grid
points through its cells. Frames are placed by value, so slow-major, snake and
cyclic orders give the same grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.tables import dealt_groups

V = F.col
#: Values within this part of a motor's range are the same by default, and within ``CONSTANT`` if the motor stands still. Fixed values.
SHARE, CONSTANT = 1e-3, 1e-6
#: Frame numbers that are compared with their neighbours in one window.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Grid:
    """A grid for each key of ``by``.

    ``points`` has a row for each frame: the keys, ``frame``, ``<motor>_index`` and the readback ``<motor>`` of each motor.
    ``axes`` has ``motor, index, centre, n`` and ``dims`` has ``motor, dim, size, changes``; dim 0 is the slowest.
    """

    points: DataFrame
    axes: DataFrame
    dims: DataFrame
    motors: tuple[str, ...]
    frame: str
    by: tuple[str, ...]
    tasks: int | None = None  # in which whole scans were placed

    @property
    def indices(self) -> list[str]:
        return [f"{m}_index" for m in self.motors]

    def positions(self) -> DataFrame:
        """Each occupied grid point with its ``frame``, the first of those there, and their number ``n``."""
        return self.points.groupBy(*self.by, *self.indices).agg(F.min(self.frame).alias(self.frame), F.count("*").alias("n"))

    def holes(self) -> DataFrame:
        """The grid points that no frame has."""
        sizes = self.dims.groupBy(*self.by).agg(*[F.max(F.when(V("motor") == m, V("size"))).alias(f"__{m}") for m in self.motors])
        full = sizes
        for m in self.motors:
            full = full.withColumn(f"{m}_index", F.explode(F.sequence(F.lit(0), V(f"__{m}") - 1)))
        at = [*self.by, *self.indices]
        full, taken = full.select(*at), self.points.select(*at).distinct()
        if self.tasks:
            full, taken = full.repartition(self.tasks, *at), taken.repartition(self.tasks, *at)
        return full.join(taken, at, "left_anti")

    def summary(self) -> DataFrame:
        """``size, occupied, missing, duplicates`` of each grid."""
        at = self.positions().groupBy(*self.by).agg(F.count("*").alias("occupied"), F.sum(V("n") - 1).alias("duplicates"))
        size = self.dims.groupBy(*self.by).agg(F.round(F.product("size")).cast("long").alias("size"))
        joined = at.join(size, list(self.by)) if self.by else at.crossJoin(F.broadcast(size))  # one row each
        return joined.select(*self.by, "size", "occupied", (V("size") - V("occupied")).alias("missing"), "duplicates")

    def motor_values(self, motor: str, readback: bool = True) -> DataFrame:
        """``frame, value`` of a motor: what was read, or the grid's centre."""
        if readback:
            return self.points.select(*self.by, self.frame, V(motor).alias("value"))
        centres = self.axes.filter(V("motor") == motor).select(*self.by, V("index").alias(f"{motor}_index"), V("centre").alias("value"))
        return self.points.join(centres, [*self.by, f"{motor}_index"]).select(*self.by, self.frame, "value")


def value_groups(frames: DataFrame, motors: tuple[str, ...], tolerance: float | dict[str, float] | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The grid points of each motor: ``by, motor, index, centre, n``, and ``by, motor, cell, index`` for looking values up; and ``tol``.

    Sorted values more than a tolerance apart begin a new point. Cells are half a tolerance wide, so that values of one cell never part; whether
    those of neighbouring cells do is told by their extremes. Missing values have no grid point.
    """
    long = _long(frames, motors, by)
    if tolerance is None or isinstance(tolerance, dict) and set(motors) - set(tolerance):
        spans = long.groupBy(*by, "motor").agg((F.max("value") - F.min("value")).alias("__span"))
        given = _given(tolerance or {}, motors)
        tol = F.coalesce(given, F.when(V("__span") > 0, V("__span") * SHARE).otherwise(CONSTANT))
        long = long.join(spans if by else F.broadcast(spans), [*by, "motor"]).withColumn("tol", tol).drop("__span")
    else:
        long = long.withColumn("tol", _given(tolerance, motors))
    own = long.withColumn("cell", F.floor(V("value") / (V("tol") / 2)))
    cells = own.groupBy(*by, "motor", "tol", "cell").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"), F.count("*").alias("n")
    )
    w = Window.partitionBy(*by, "motor").orderBy("cell")
    new = F.when(V("low") - F.lag("high").over(w) > V("tol"), 1).otherwise(0)
    index = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    grouped = cells.withColumn("__new", new).withColumn("index", index).drop("__new")
    axes = grouped.groupBy(*by, "motor", "index").agg((F.sum("total") / F.sum("n")).alias("centre"), F.sum("n").alias("n"))
    return axes, grouped.select(*by, "motor", "tol", "cell", "index")


def _given(tolerance: float | dict[str, float], motors: tuple[str, ...]) -> Column:
    if not isinstance(tolerance, dict):
        return F.lit(float(tolerance))
    out = F.lit(None).cast("double")
    for m in motors:
        out = F.when(V("motor") == m, F.lit(float(tolerance[m]))).otherwise(out) if m in tolerance else out
    return out


def _long(frames: DataFrame, motors: tuple[str, ...], by: tuple[str, ...], *keep: str) -> DataFrame:
    """``by, keep, motor, value``: a row for each motor of a frame; NaN and null go."""
    rows = F.array(*[F.struct(F.lit(m).alias("motor"), V(m).cast("double").alias("value")) for m in motors])
    return frames.select(*by, *keep, F.explode(rows).alias("r")).select(*by, *keep, "r.*").filter(V("value").isNotNull() & ~F.isnan("value"))


def detect(
    frames: DataFrame,
    motors: tuple[str, ...],
    frame: str = "frame_id",
    tolerance: float | dict[str, float] | None = None,
    order: tuple[str, ...] | None = None,
    by: tuple[str, ...] = (),
    block: int = BLOCK,
) -> Grid:
    """The grid of the ``motors`` of each scan, a scan being the rows of one key of ``by``, or all rows.

    ``frame`` numbers a scan's frames and is distinct within it. Axes run from the motor that changes least often between
    consecutive frames to the one that changes most, motors alike in the order given, or in ``order``. Frames that lack a motor's value are left out.
    Changes are counted in blocks of frame numbers, and between blocks by their ends. Unless a scan is very long, whole scans are
    dealt over tasks once, by their number of frames, and nothing is shuffled or joined to place their frames.
    """
    own, tasks = dealt_groups(frames.select(*by, frame, *motors), *by)
    if tasks:
        found = _placed(own, motors, tolerance, by, frame)
        axes = found.groupBy(*by, "motor", "index").agg((F.sum("value") / F.count("*")).alias("centre"), F.count("*").alias("n"))
    else:
        axes, lookup = value_groups(frames, motors, tolerance, by)
        long = _long(frames, motors, by, frame)
        tols = lookup.select(*by, "motor", "tol").distinct()
        found = long.join(F.broadcast(tols) if not by else tols, [*by, "motor"]).withColumn("cell", F.floor(V("value") / (V("tol") / 2)))
        found = found.join(lookup.drop("tol"), [*by, "motor", "cell"])
    wide = found.groupBy(*by, frame).agg(
        *[F.max(F.when(V("motor") == m, V("index"))).alias(f"{m}_index") for m in motors], *[F.max(F.when(V("motor") == m, V("value"))).alias(m) for m in motors]
    )
    points = wide.filter(" AND ".join(f"`{m}_index` IS NOT NULL" for m in motors))
    sizes = axes.groupBy(*by, "motor").agg((F.max("index") + 1).alias("size"))
    if order is not None:
        place = F.array_position(F.lit(list(order)), V("motor")).cast("int") - 1
        dims = sizes.withColumn("dim", place).withColumn("changes", F.lit(None).cast("long"))
    else:
        given = F.array_position(F.lit(list(motors)), V("motor"))
        joined = sizes.join(changes(points, motors, frame, by, block), [*by, "motor"])
        dims = joined.withColumn("dim", F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy("changes", given)) - 1)  # one row a motor
    return Grid(points, axes, dims.select(*by, "motor", "dim", "size", "changes"), motors, frame, by, tasks)


def _placed(frames: DataFrame, motors: tuple[str, ...], tolerance: float | dict[str, float] | None, by: tuple[str, ...], frame: str) -> DataFrame:
    """``by, frame, motor, value, index`` of each value of scans that are whole in their tasks: a scan's values in order, as in ``value_groups``."""
    whole = Window.partitionBy(*by, "motor")
    span = F.max("value").over(whole) - F.min("value").over(whole)
    tol = F.coalesce(_given({} if tolerance is None else tolerance, motors), F.when(span > 0, span * SHARE).otherwise(CONSTANT))
    long = _long(frames, motors, by, frame).withColumn("tol", tol)
    order = whole.orderBy("value")
    new = F.when(V("value") - F.lag("value").over(order) > V("tol"), 1).otherwise(0)
    index = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return long.withColumn("__new", new).withColumn("index", index).drop("__new", "tol")


def changes(points: DataFrame, motors: tuple[str, ...], frame: str, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``motor, changes``: how often each motor's grid index differs between consecutive frames."""
    at = F.struct(*[f"{m}_index" for m in motors])
    own = points.select(*by, F.floor(V(frame) / block).alias("__block"), V(frame).alias("__frame"), at.alias("__at"))
    w = Window.partitionBy(*by, "__block").orderBy("__frame")
    own = own.withColumn("__was", F.lag("__at").over(w))
    differ = lambda m, now, was: F.sum(F.when(V(f"{now}.{m}_index") != V(f"{was}.{m}_index"), 1).otherwise(0))
    inner = own.groupBy(*by, "__block").agg(
        *[differ(m, "__at", "__was").alias(f"__{m}") for m in motors], F.min_by("__at", "__frame").alias("__first"), F.max_by("__at", "__frame").alias("__last")
    )
    b = Window.partitionBy(*by, F.lit(0)).orderBy("__block")  # one row for each block
    inner = inner.withColumn("__was", F.lag("__last").over(b))
    total = inner.groupBy(*by).agg(*[(F.sum(f"__{m}") + differ(m, "__first", "__was")).alias(f"__{m}") for m in motors])
    return total.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("motor"), V(f"__{m}").cast("long").alias("changes")) for m in motors])))


def raster(at: Column, sizes: tuple[int, ...], snake: bool = False) -> list[Column]:
    """The indices, slow first, of the ``at``-th point of a raster; ``snake`` runs the last axis backwards on every other row.

    A point beyond the raster is an error.
    """
    total = 1
    for s in sizes:
        total *= s
    inside = F.when(at < total, at).otherwise(F.raise_error(F.lit(f"a raster of {sizes} has no room for all points")).cast("long"))
    out, left = [], inside
    for k in range(len(sizes) - 1, -1, -1):
        out.append((left % sizes[k]).cast("int"))
        left = F.floor(left / sizes[k])
    out.reverse()
    if snake and len(sizes) > 1:
        row = F.floor(inside / sizes[-1])
        out[-1] = F.when(row % 2 == 1, F.lit(sizes[-1] - 1) - out[-1]).otherwise(out[-1])
    return out


def from_grid(frames: DataFrame, frame: str, sizes: dict[str, int], snake: bool = False) -> DataFrame:
    """``frames`` with ``<motor>_index`` of a regular grid that was run through slow-major, perhaps not to its end."""
    found = raster(V(frame), tuple(sizes.values()), snake)
    return frames.withColumns({f"{m}_index": c for m, c in zip(sizes, found, strict=True)})


def split(points: DataFrame, dim: str, axes: dict[str, int], snake: bool = False) -> DataFrame:
    """The axis ``dim`` of a grid's points replaced by several, slow first: a series of frames as the raster that it was."""
    clash = [f"{m}_index" for m in axes if f"{m}_index" in points.columns and m != dim]
    if clash or not axes:
        raise ValueError(f"the new axes {list(axes)} must have new names")
    found = raster(V(f"{dim}_index"), tuple(axes.values()), snake)
    return points.withColumns({f"__{m}": c for m, c in zip(axes, found, strict=True)}).drop(f"{dim}_index").withColumnsRenamed({f"__{m}": f"{m}_index" for m in axes})


def layer(points: DataFrame, dim: str, index: int) -> DataFrame:
    """The points at one place of the axis ``dim``, which leaves; its readback, where there is one, stays."""
    return points.filter(V(f"{dim}_index") == index).drop(f"{dim}_index")


def sub(points: DataFrame, region: dict[str, tuple[int, int]]) -> DataFrame:
    """The part of a grid within half-open ranges of its indices, which count from the ranges' start then."""
    for m, (low, high) in region.items():
        points = points.filter((V(f"{m}_index") >= low) & (V(f"{m}_index") < high)).withColumn(f"{m}_index", V(f"{m}_index") - low)
    return points
