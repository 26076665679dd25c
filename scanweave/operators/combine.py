"""Combining objects ``(dims..., value, sigma)``: arithmetic with uncertainty, averages, stacks, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V = F.col


def arithmetic(a: DataFrame, b: DataFrame, op: str, dims: tuple[str, ...]) -> DataFrame:
    """``value, sigma`` of ``a op b`` where both have the same ``dims``, with first-order propagation.

    ``b`` may lack dimensions of ``a``; those that it has are joined on.
    """
    shared = [d for d in dims if d in b.columns]
    other = b.select(*shared, V("value").alias("__b"), V("sigma").alias("__s"))
    joined = a.join(other, shared) if shared else a.crossJoin(F.broadcast(other))
    x, y, sx, sy = V("value"), V("__b"), V("sigma"), V("__s")
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    if op in "+-":
        sigma = F.hypot(sx, sy)
    else:
        sigma = F.abs(value) * F.hypot(F.try_divide(sx, x), F.try_divide(sy, y))
    return joined.select(*[d for d in dims if d in a.columns], value.alias("value"), sigma.alias("sigma"))


def average(objects: list[DataFrame], dims: tuple[str, ...], how: str = "mean") -> DataFrame:
    """Mean, sum or inverse-variance mean over objects; nulls are skipped, and values without uncertainty weigh nothing."""
    both = objects[0]
    for o in objects[1:]:
        both = both.unionByName(o)
    if how == "weighted":
        weight = F.when(V("sigma") > 0, 1 / (V("sigma") * V("sigma"))).otherwise(0.0)
        sums = both.groupBy(*dims).agg(F.sum(V("value") * weight).alias("wv"), F.sum(weight).alias("w"))
        return sums.select(*dims, F.try_divide("wv", "w").alias("value"), F.try_divide(F.lit(1.0), F.sqrt("w")).alias("sigma"))
    square = F.sqrt(F.sum(V("sigma") * V("sigma")))
    if how == "sum":
        return both.groupBy(*dims).agg(F.sum("value").alias("value"), square.alias("sigma"))
    return both.groupBy(*dims).agg(F.avg("value").alias("value"), (square / F.lit(float(len(objects)))).alias("sigma"))


def concatenate(objects: list[DataFrame]) -> DataFrame:
    out = objects[0]
    for o in objects[1:]:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


def stack_objects(objects: list[DataFrame], dim: str = "index", values: list[float] | None = None) -> DataFrame:
    """Objects along a new leading dimension."""
    return concatenate([o.withColumn(dim, F.lit(v)) for o, v in zip(objects, values or list(range(len(objects))), strict=True)])


def stack_grid(values: DataFrame, outer: DataFrame, inner: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Values on the full grid of two axes' coordinates, null where there is none; both axes are small tables of coordinates."""
    grid = outer.crossJoin(F.broadcast(inner))
    return grid.join(values, list(on), "left")


def mosaic(tiles: DataFrame, offsets: DataFrame, tile: str, how: str = "mean") -> DataFrame:
    """Tiles ``(tile, y, x, v)`` at their row and column offsets in one image; overlaps by mean, maximum or sum."""
    placed = tiles.join(offsets.select(tile, "dy", "dx"), tile)
    at = placed.select((V("y") + V("dy")).alias("y"), (V("x") + V("dx")).alias("x"), "v")
    return at.groupBy("y", "x").agg({"mean": F.avg, "max": F.max, "sum": F.sum}[how]("v").alias("v"))


def overlap_offset(a: DataFrame, b: DataFrame, offsets: range, least: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, k, score, n``: the shift k of each series ``b(by, i, v)`` against ``a(i, v)`` with the least mean absolute difference, the first on a tie."""
    shifts = F.array(*[F.lit(k) for k in offsets])
    shifted = b.select(*by, F.explode(shifts).alias("k"), "i", V("v").alias("w")).select(*by, "k", (V("i") + V("k")).alias("i"), "w")
    scores = shifted.join(a.select("i", "v"), "i").groupBy(*by, "k").agg(F.avg(F.abs(V("v") - V("w"))).alias("score"), F.count("*").alias("n"))
    best = F.min_by(F.struct("k", "score", "n"), F.struct("score", F.abs("k"), "k")).alias("best")
    return scores.filter(V("n") >= least).groupBy(*by).agg(best).select(*by, "best.*")


def normalize(df: DataFrame, value: str, by: Column) -> DataFrame:
    """Values over a monitor; without beam the result is null."""
    return df.withColumn(value, V(value) / F.when(by > 0, by))
