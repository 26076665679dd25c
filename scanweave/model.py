"""The data model: cells of frames on a grid of scan axes, and regions of interest.

A stack of detector frames is a long table ``(..., frame_id, y, x, v)`` with one row
per pixel, and the scan axes are plain columns, so every region is a pushed
filter and every reduction a group-by with map-side partial sums. Missing values are
null inside the engine; ``nan_to_null`` is applied where data come in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.tables import dealt_groups

PIXEL_DIMS = ("y", "x")


def nan_to_null(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def cells(frames: DataFrame, pixels: str, width: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns with ``y, x, v``: one row per pixel of an array column stored row by row."""
    spread = frames.select(*keep, F.posexplode(pixels).alias("__at", "__v"))
    return spread.select(
        *keep,
        F.expr(f"__at div {width}").cast("int").alias("y"),
        (F.col("__at") % width).cast("int").alias("x"),
        F.col("__v").cast("double").alias("v"),
    )


@dataclass(frozen=True)
class Roi:
    """Ranges by dimension: pixels are half-open, motors inclusive; ``None`` leaves a side open."""

    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def predicate(self) -> Column:
        """The filter that Catalyst pushes to the scan."""
        found = F.lit(True)
        for dim, (low, high) in self.ranges.items():
            if low is not None:
                found = found & (F.col(dim) >= low)
            if high is not None:
                found = found & ((F.col(dim) < high) if dim in PIXEL_DIMS else (F.col(dim) <= high))
        return found

    def of(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate()) if self.ranges else df

    @classmethod
    def parse(cls, text: str | None) -> Roi:
        """``"y=700:1100,x=800:,chi=-0.2:0.2"``: whole numbers for pixels, values for motors; a side left out is open."""
        ranges: dict[str, tuple[float | None, float | None]] = {}
        for part in filter(str.strip, (text or "").split(",")):
            dim, equals, ends = part.partition("=")
            low, colon, high = ends.partition(":")
            if not (equals and colon and dim.strip()):
                raise ValueError(f"{part!r} is not dim=low:high")
            number = int if dim.strip() in PIXEL_DIMS else float
            ranges[dim.strip()] = tuple(number(e) if e.strip() else None for e in (low, high))
        return cls(ranges)

    def text(self) -> str:
        """What ``parse`` reads."""
        side = lambda v: "" if v is None else f"{v:g}" if float(f"{v:g}") == v else repr(v)
        return ",".join(f"{dim}={side(low)}:{side(high)}" for dim, (low, high) in self.ranges.items())

    def scaled(self, factors: dict[str, int]) -> Roi:
        """The region in full pixels, where its pixel ranges count blocks of so many."""
        grown = lambda dim, v: None if v is None else int(v) * factors.get(dim, 1)
        return Roi({d: tuple(grown(d, v) for v in r) if d in PIXEL_DIMS else r for d, r in self.ranges.items()})

    def in_pixels(self, axes: dict[str, tuple[float, float]]) -> Roi:
        """The region in full pixels, where its pixel ranges are indices of an image whose axes have this origin and step."""
        at = lambda d, v: None if v is None else round(axes[d][0] + v * axes[d][1])
        return Roi({d: tuple(at(d, v) for v in r) if d in axes else r for d, r in self.ranges.items()})

    def indices(self, sizes: dict[str, int], axes: dict[str, tuple[float, float]] | None = None) -> dict[str, tuple[int, int]]:
        """The region as half-open index ranges of an image of these sizes, whose axes have an origin and a step."""
        out = {}
        for dim, size in sizes.items():
            (low, high), (origin, step) = self.ranges.get(dim, (None, None)), (axes or {}).get(dim, (0.0, 1.0))
            out[dim] = (0 if low is None else max(round((low - origin) / step), 0), size if high is None else min(round((high - origin) / step), size))
        return out


def select_range(df: DataFrame, dim: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Inclusive on both sides, on pixels too."""
    if low is not None:
        df = df.filter(F.col(dim) >= low)
    return df.filter(F.col(dim) <= high) if high is not None else df


def decimate(df: DataFrame, index: str, step: int) -> DataFrame:
    """Every ``step``-th point of a motor."""
    return df.filter(F.col(index) % step == 0)


def bin_pixels(df: DataFrame, by: tuple[str, ...], factor: int, height: int, width: int, how: str = "mean") -> DataFrame:
    """Blocks of ``factor`` by ``factor`` pixels as ``yb, xb, v``; rows and columns left over are trimmed."""
    kept = df.filter((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    block = [F.expr(f"{d} div {factor}").cast("int").alias(f"{d}b") for d in PIXEL_DIMS]
    return kept.groupBy(*by, *block).agg({"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]("v").alias("v"))


def contiguous_runs(ids: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``start, stop`` of the runs of consecutive ids, stop excluded."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(column)
    island = dealt_groups(ids.select(*by, column), *by)[0].distinct().withColumn("__i", F.col(column) - F.row_number().over(order))
    runs = island.groupBy(*by, "__i").agg(F.min(column).alias("start"), (F.max(column) + 1).alias("stop"))
    return runs.drop("__i")


def first_frame_per_point(df: DataFrame, point: tuple[str, ...], frame: str) -> DataFrame:
    """One frame for each grid position; of duplicates the first wins."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*point).orderBy(frame))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")
