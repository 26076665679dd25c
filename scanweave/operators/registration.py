"""Frames moved onto one another, and tiles of a mosaic placed where they fit best.

Frames are rows ``(by, frame, pixels)``, the pixels an array stored row by row; one key of ``by`` is a stack. Shifts are found in Arrow
batches, a pair of frames a row, and applied by array expressions, so pixels are never spread over rows here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.tables import dealt_join

V = F.col


def packed(cells: DataFrame, by: tuple[str, ...], width: int) -> DataFrame:
    """``by, pixels``: the rows ``(by, y, x, v)`` of whole frames as one array a frame."""
    listed = F.array_sort(F.collect_list(F.struct((V("y") * width + V("x")).alias("at"), V("v").cast("double").alias("v"))))
    return cells.groupBy(*by).agg(F.transform(listed, lambda p: p["v"]).alias("pixels"))


def unpacked(frames: DataFrame, keep: tuple[str, ...], width: int) -> DataFrame:
    """``keep, y, x, v``: a row for each pixel."""
    spread = frames.select(*keep, F.posexplode("pixels").alias("__at", "v"))
    return spread.select(*keep, F.floor(V("__at") / width).cast("int").alias("y"), (V("__at") % width).cast("int").alias("x"), "v")


def _kind(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def shifts(pairs: DataFrame, keys: tuple[str, ...], height: int, width: int, max_shift: int | None = None) -> DataFrame:
    """``keys, dy, dx``: the whole-pixel shift that moves ``pixels`` onto ``reference``, by their circular cross-correlation.

    With ``max_shift`` only shifts of at most so many pixels are considered. The first of equal ones in row order wins.
    """
    reach = lambda n: np.arange(n) if max_shift is None else np.arange(-max_shift, max_shift + 1)
    rows, columns = reach(height), reach(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ref, own = (np.stack([np.asarray(p, dtype=float) for p in batch[c]]).reshape(-1, height, width) for c in ("reference", "pixels"))
            ref, own = (s - s.mean(axis=(1, 2), keepdims=True) for s in (ref, own))
            score = np.fft.irfft2(np.fft.rfft2(ref) * np.conj(np.fft.rfft2(own)), s=(height, width))
            best = score[:, rows[:, None] % height, columns % width].reshape(len(batch), -1).argmax(axis=1)
            dy, dx = rows[best // len(columns)], columns[best % len(columns)]
            if max_shift is None:
                dy, dx = np.where(dy > height // 2, dy - height, dy), np.where(dx > width // 2, dx - width, dx)
            yield batch[list(keys)].assign(dy=dy.astype(np.int32), dx=dx.astype(np.int32))

    own = pairs.filter(V("reference").isNotNull() & V("pixels").isNotNull()).select(*keys, "reference", "pixels")
    return own.mapInPandas(run, f"{_kind(pairs, *keys)}, dy int, dx int")


def stack_shifts(frames: DataFrame, frame: str, by: tuple[str, ...], height: int, width: int, max_shift: int | None = 5, chained: bool = False) -> DataFrame:
    """``by, frame, dy, dx``: the shift that moves each frame onto the first one of its stack; the first has none.

    Frames are compared with the first, or, ``chained``, with the one before each, whose shifts add up; then content may drift further than ``max_shift``.
    """
    light = frames.select(*by, frame)
    if chained:
        order = light.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(frame)))
        numbered = frames.select(*by, frame, "pixels").join(order, [*by, frame])
        before = numbered.select(*by, (V("__at") + 1).alias("__at"), V("pixels").alias("reference"))
        found = shifts(numbered.join(before, [*by, "__at"]), (*by, frame), height, width, max_shift)
        steps = light.join(found, [*by, frame], "left")
        so_far = Window.partitionBy(*by).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
        return steps.select(*by, frame, *[F.coalesce(F.sum(d).over(so_far), F.lit(0)).cast("int").alias(d) for d in ("dy", "dx")])
    first = light.groupBy(*by).agg(F.min(frame).alias(frame))
    keys = [*by, frame]
    references = frames.join(first, keys, "left_semi").select(*by, V(frame).alias("__first"), V("pixels").alias("reference"))
    own = frames.select(*by, frame, "pixels")
    joined = dealt_join(own, references, list(by)) if by else own.crossJoin(F.broadcast(references))  # one frame
    found = shifts(joined.filter(V(frame) != V("__first")), (*by, frame), height, width, max_shift)
    return light.join(found, keys, "left").select(*keys, *[F.coalesce(d, F.lit(0)).alias(d) for d in ("dy", "dx")])


def expected_shifts(frames: DataFrame, frame: str, motor: str, by: tuple[str, ...], pixels_per_unit: float = 1.0) -> DataFrame:
    """``by, frame, expected``: a motor's way since the first frame of the stack, in pixels."""
    first = frames.groupBy(*by).agg(F.min_by(motor, frame).alias("__first"))
    joined = frames.join(first, list(by)) if by else frames.crossJoin(F.broadcast(first))  # one row
    return joined.select(*by, frame, ((V(motor) - V("__first")) * pixels_per_unit).alias("expected"))


def moved(pixels: Column, rows: Column, columns: Column, height: int, width: int, fill: float | None) -> Column:
    """The array of a frame moved down by ``rows`` and right by ``columns``, parts of a pixel by linear interpolation.

    Where the content would come from outside the frame, the value is ``fill``.
    """

    def at(y: Column, x: Column) -> Column:
        return F.get(pixels, (y * width + x).cast("int"))

    def between(share: Column, a: Column, b: Column) -> Column:
        return F.when(share == 0, a).otherwise(a * (1 - share) + b * share)

    def value(_: Column, i: Column) -> Column:
        sy, sx = F.floor(i / width) - rows, i % width - columns
        y, x = F.floor(sy), F.floor(sx)
        upper = between(sx - x, at(y, x), at(y, x + 1))
        lower = between(sx - x, at(y + 1, x), at(y + 1, x + 1))
        inside = (sy >= 0) & (sy <= height - 1) & (sx >= 0) & (sx <= width - 1)
        return F.when(inside, between(sy - y, upper, lower)).otherwise(F.lit(fill).cast("double"))

    return F.transform(pixels, value)


def shift_frames(frames: DataFrame, height: int, width: int, rows: Column | float = 0.0, columns: Column | float = 0.0, fill: float | None = None) -> DataFrame:
    """``frames`` with their pixels moved by parts of a pixel; what is uncovered is null."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return frames.withColumn("pixels", moved(V("pixels"), as_column(rows), as_column(columns), height, width, fill))


def align_stack(
    frames: DataFrame, frame: str, by: tuple[str, ...], height: int, width: int, max_shift: int | None = 5, chained: bool = False, expected: DataFrame | None = None
) -> DataFrame:
    """``frames`` moved onto the first of their stack, with ``dy, dx``; what is uncovered is zero.

    ``expected(by, frame, ey, ex)`` are shifts known beforehand, to which those found are added.
    """
    found = stack_shifts(frames, frame, by, height, width, max_shift, chained)
    total = found.select(*by, frame, *[V(d).cast("double").alias(d) for d in ("dy", "dx")])
    if expected is not None:
        known = expected.select(*by, frame, "ey", "ex")
        total = total.join(known, [*by, frame], "left").select(*by, frame, *[(V(d) + F.coalesce(e, F.lit(0.0))).alias(d) for d, e in (("dy", "ey"), ("dx", "ex"))])
    return shift_frames(frames.join(total, [*by, frame]), height, width, V("dy"), V("dx"), 0.0)


def grid_positions(tiles: DataFrame, row: str, column: str, step_y: int, step_x: int) -> DataFrame:
    """``tiles`` with the corner ``y0, x0`` of each on a regular grid of positions."""
    return tiles.withColumns({"y0": V(row) * step_y, "x0": V(column) * step_x})


def overlapping(positions: DataFrame, mosaic: str, tile: str, height: int, width: int) -> DataFrame:
    """``mosaic, a, b, y, x``: the pairs of tiles, ``a < b``, that share pixels, and the way from one corner to the other."""
    cell = positions.select(mosaic, tile, "y0", "x0", F.floor(V("y0") / height).alias("i"), F.floor(V("x0") / width).alias("j"))
    near = F.explode(F.array(*[F.struct((V("i") + a).alias("i"), (V("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = cell.select(mosaic, V(tile).alias("a"), V("y0").alias("ya"), V("x0").alias("xa"), near.alias("c")).select(mosaic, "a", "ya", "xa", "c.*")
    met = spread.hint("merge").join(cell.withColumnRenamed(tile, "b"), [mosaic, "i", "j"]).filter("a < b")
    way = met.select(mosaic, "a", "b", (V("y0") - V("ya")).cast("int").alias("y"), (V("x0") - V("xa")).cast("int").alias("x"))
    return way.filter((F.abs("y") < height) & (F.abs("x") < width))


def pair_offsets(tiles: DataFrame, pairs: DataFrame, mosaic: str, tile: str, height: int, width: int, max_shift: int, least: int = 16) -> DataFrame:
    """``mosaic, a, b, dy, dx, n``: what is to be added to the way between two tiles so that their shared pixels differ least on average.

    ``n`` is the number of shared pixels. Pairs in which some shift leaves fewer than ``least`` of them tell nothing and go.
    """
    pairs = pairs.filter((height - F.abs("y") > max_shift) & (width - F.abs("x") > max_shift))
    pairs = pairs.filter((height - F.abs("y") - max_shift) * (width - F.abs("x") - max_shift) >= least)
    reach = range(-max_shift, max_shift + 1)

    def best(a: np.ndarray, b: np.ndarray, y: int, x: int) -> tuple[int, int, int]:
        scores = []
        for dy in reach:
            for dx in reach:
                oy, ox = y + dy, x + dx
                over = a[max(oy, 0) : height + min(oy, 0), max(ox, 0) : width + min(ox, 0)]
                under = b[max(-oy, 0) : height + min(-oy, 0), max(-ox, 0) : width + min(-ox, 0)]
                scores.append((float(np.abs(over - under).mean()), abs(dy) + abs(dx), dy, dx, over.size))
        return min(scores)[2:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for m, a, b, y, x, pa, pb in batch.itertuples(index=False, name=None):
                over, under = (np.asarray(p, dtype=float).reshape(height, width) for p in (pa, pb))
                rows.append((m, a, b, *best(over, under, y, x)))
            yield pd.DataFrame(rows, columns=[mosaic, "a", "b", "dy", "dx", "n"])

    own = tiles.select(mosaic, tile, "pixels")
    one, other = (own.select(mosaic, V(tile).alias(c), V("pixels").alias(f"p{c}")).hint("merge") for c in "ab")  # frames are never broadcast
    both = pairs.join(one, [mosaic, "a"]).join(other, [mosaic, "b"])
    ordered = both.select(mosaic, "a", "b", "y", "x", "pa", "pb")
    return ordered.mapInPandas(run, f"{_kind(ordered, mosaic, 'a', 'b')}, dy int, dx int, n int")


def _solved(a: np.ndarray, b: np.ndarray, weight: np.ndarray, way: np.ndarray, n: int) -> np.ndarray:
    """The corrections c of least norm for which c[b] - c[a] is nearest ``way``, by conjugate gradients on the normal equations."""

    def normal(c: np.ndarray) -> np.ndarray:
        return spread(weight[:, None] * (c[b] - c[a]))

    def spread(rows: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(b, r, n) - np.bincount(a, r, n) for r in rows.T], axis=1)

    c = np.zeros((n, 2))
    rest = spread(weight[:, None] * way)
    goal, step = 1e-24 * max(float((rest * rest).sum()), 1e-300), rest.copy()
    size = (rest * rest).sum(axis=0)
    for _ in range(10 * n + 50):
        if size.sum() <= goal:
            break
        along = normal(step)
        by = size / np.maximum((step * along).sum(axis=0), 1e-300)
        c += by * step
        rest -= by * along
        new = (rest * rest).sum(axis=0)
        step = rest + new / np.maximum(size, 1e-300) * step
        size = new
    return c


def refined_positions(tiles: DataFrame, positions: DataFrame, mosaic: str, tile: str, height: int, width: int, max_shift: int = 4, least: int = 16) -> DataFrame:
    """``mosaic, tile, y0, x0``: the tiles' corners moved so that the ways between overlapping tiles fit best, in the least-squares sense.

    The corrections of tiles that overlaps connect sum to zero, as only differences are known. ``tiles`` has ``pixels``,
    ``positions`` the corners ``y0, x0`` in pixels by the stage. One mosaic's pairs, some numbers each, are solved in one task.
    """
    pairs = overlapping(positions, mosaic, tile, height, width)
    found = pair_offsets(tiles, pairs, mosaic, tile, height, width, max_shift, least)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        names = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]))
        at = [np.searchsorted(names, rows[c].to_numpy()) for c in "ab"]
        c = _solved(*at, rows["n"].to_numpy(float), rows[["dy", "dx"]].to_numpy(float), len(names))
        return pd.DataFrame({mosaic: rows[mosaic].iloc[0], tile: names, "cy": c[:, 0], "cx": c[:, 1]})

    solved = found.groupBy(mosaic).applyInPandas(solve, f"{_kind(positions, mosaic, tile)}, cy double, cx double")
    joined = positions.hint("merge").join(solved, [mosaic, tile], "left")
    return joined.select(mosaic, tile, *[(V(f"{d}0") + F.coalesce(f"c{d}", F.lit(0.0))).alias(f"{d}0") for d in "yx"])
