"""Density clusters of points in two dimensions, by a grid of cells.

A cell's diagonal is ``eps``, so all points of one cell are near each other: a cell
with enough points has core points only, whatever their number, and all core
points of a cell belong together. What is left are the neighbours of points in
sparse cells, and which neighbouring cells are linked. The latter is decided by the boxes
around their core points, which are split until a pair of boxes is
near as a whole, far as a whole, or small. So no cell's points are
paired with one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.operators.components import components
from scanweave.tables import dealt_join, written

V = F.col
#: Cells that may hold points within eps of a cell's points: all but the corners of five by five.
NEAR = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]
#: Points of a box that are compared one by one.
SMALL_BOX = 16


def _cells(offsets: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct((V("cx") + i).alias("cx"), (V("cy") + j).alias("cy")) for i, j in offsets]))


def _places(points: DataFrame, a: str, b: str, eps: float, scale: bool) -> DataFrame:
    """``a, b, x, y, cx, cy, n, least``: each place that has points, in units of eps, its cell, number of points and least id."""
    own = points.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    if scale:
        both = own.withColumn("n", V("n").cast("double"))
        mean = lambda c: (F.sum(V(c) * V("n")) / F.sum("n")).alias(f"{c}_mean")
        means = both.agg(mean("a"), mean("b"))
        squares = lambda c: F.sqrt(F.sum((V(c) - V(f"{c}_mean")) * (V(c) - V(f"{c}_mean")) * V("n")) / F.sum("n"))
        stats = both.crossJoin(F.broadcast(means)).agg(*[F.first(f"{c}_mean").alias(f"{c}_mean") for c in "ab"], squares("a").alias("a_std"), squares("b").alias("b_std"))
        own = own.crossJoin(F.broadcast(stats))  # one row
        unit = lambda c: (V(c) - V(f"{c}_mean")) / F.when(V(f"{c}_std") > 0, V(f"{c}_std")).otherwise(1.0) / eps
    else:
        unit = lambda c: V(c) / eps
    side = 2**0.5 * (1 + 1e-9)  # cells a little smaller than that, as sums round
    placed = own.select("a", "b", unit("a").alias("x"), unit("b").alias("y"), "n", "least")
    return placed.withColumns({"cx": F.floor(V("x") * side), "cy": F.floor(V("y") * side)})


def _near(few: DataFrame, many: DataFrame) -> DataFrame:
    """The pairs of places of ``few`` and ``many`` within eps; the columns of ``many`` are its own, ``few`` is the struct ``p``."""
    spread = few.select(F.struct(*few.columns).alias("p"), "cx", "cy").select("p", _cells(NEAR).alias("c")).select("p", "c.*")
    met = dealt_join(many, spread, ["cx", "cy"])
    dx, dy = V("x") - V("p.x"), V("y") - V("p.y")
    return met.filter(dx * dx + dy * dy <= 1)


def _boxes(core: DataFrame, level: int) -> DataFrame:
    """``cx, cy, bx, by``: the boxes around the core points of each part of a cell, cells being halved ``level`` times each way."""
    part = [F.floor(V(c) * (2**0.5 * (1 + 1e-9) * 2**level)).alias(b) for c, b in (("x", "bx"), ("y", "by"))]
    extent = [f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "low"), (F.max, "high"))]
    return core.select("cx", "cy", "x", "y", *part).groupBy("cx", "cy", "bx", "by").agg(*extent, F.count("*").alias("places"))


def _named(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.select(V("cx").alias(f"{side}x"), V("cy").alias(f"{side}y"), F.struct("bx", "by", "low_x", "high_x", "low_y", "high_y", "places").alias(side))


def _links(core: DataFrame) -> DataFrame:
    """``px, py, qx, qy``: the pairs of neighbouring cells that have core points within eps of one another."""
    half = [o for o in NEAR if o > (0, 0)]
    cells = core.select("cx", "cy").distinct()
    pairs = cells.select(V("cx").alias("px"), V("cy").alias("py"), _cells(half).alias("c")).select("px", "py", V("c.cx").alias("qx"), V("c.cy").alias("qy"))
    pairs = pairs.join(cells.select(V("cx").alias("qx"), V("cy").alias("qy")), ["qx", "qy"], "left_semi").select("px", "py", "qx", "qy")
    found, level = [], 0
    open_ = written(pairs, "cells")
    near, far = (
        sum_of(lambda s: F.greatest(V(f"p.low_{s}") - V(f"q.high_{s}"), V(f"q.low_{s}") - V(f"p.high_{s}"), F.lit(0.0))),
        sum_of(lambda s: F.greatest(V(f"p.high_{s}") - V(f"q.low_{s}"), V(f"q.high_{s}") - V(f"p.low_{s}"))),
    )
    cell = ["px", "py", "qx", "qy"]
    while not open_.isEmpty():
        parts = _boxes(core, level)
        met = open_.join(_named(parts, "p"), ["px", "py"]).join(_named(parts, "q"), ["qx", "qy"]) if level == 0 else _halved(open_, parts)
        tried = written(met.filter(near <= 1).select(*cell, "p", "q", (far <= 1).alias("linked")), "boxes")
        linked = tried.filter("linked").select(*cell).distinct()
        left = tried.join(linked, cell, "left_anti").drop("linked")
        small = (V("p.places") <= SMALL_BOX) & (V("q.places") <= SMALL_BOX)
        compared = _compared(core, left.filter(small), level)
        done = written(linked.unionByName(compared).distinct(), "links")
        found.append(done)
        open_ = written(left.filter(~small).join(done, cell, "left_anti"), "boxes")
        level += 1
    out = found[0] if found else pairs.limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sum_of(part) -> Column:
    """The squared distance whose parts along x and y are given."""
    return part("x") * part("x") + part("y") * part("y")


def _halved(open_: DataFrame, parts: DataFrame) -> DataFrame:
    """The open pairs of boxes, each replaced by the pairs of the four parts of both."""
    rows = open_.select("px", "py", "qx", "qy", *[V(f"{s}.b{c}").alias(f"{s}b{c}") for s in "pq" for c in "xy"])
    for s in "pq":
        up = parts.withColumns({f"{s}bx": F.floor(V("bx") / 2), f"{s}by": F.floor(V("by") / 2)})
        own = up.select(V("cx").alias(f"{s}x"), V("cy").alias(f"{s}y"), f"{s}bx", f"{s}by", F.struct("bx", "by", "low_x", "high_x", "low_y", "high_y", "places").alias(s))
        rows = rows.join(own, [f"{s}x", f"{s}y", f"{s}bx", f"{s}by"])
    return rows


def _compared(core: DataFrame, pairs: DataFrame, level: int) -> DataFrame:
    """The cells of those pairs of small boxes that hold places within eps of one another."""
    size = 2**0.5 * (1 + 1e-9) * 2**level
    rows = pairs.select("px", "py", "qx", "qy", *[V(f"{s}.b{c}").alias(f"{s}b{c}") for s in "pq" for c in "xy"])
    for s in "pq":
        own = core.select(*[V(f"c{c}").alias(f"{s}{c}") for c in "xy"], *[F.floor(V(c) * size).alias(f"{s}b{c}") for c in "xy"], *[V(c).alias(f"{s}_{c}") for c in "xy"])
        rows = rows.join(own, [f"{s}x", f"{s}y", f"{s}bx", f"{s}by"])
    dx, dy = V("p_x") - V("q_x"), V("p_y") - V("q_y")
    return rows.filter(dx * dx + dy * dy <= 1).select("px", "py", "qx", "qy")


def dbscan(points: DataFrame, id_col: str, a: str, b: str, eps: float = 2.0, min_samples: int = 5, scale: bool = True) -> DataFrame:
    """``id_col, cluster`` of each row of ``points``: the least id among the core points of its cluster, -1 for noise.

    A core point has ``min_samples`` points within ``eps``, itself included; a point that is near core points of several
    clusters goes to that of the least id. With ``scale`` both columns are
    standardised first. Rows with a missing or infinite value have a null cluster; ids are
    integers, distinct and not negative. An empty table gives an empty result.
    """
    own = points.select(V(id_col).cast("long").alias("id"), V(a).cast("double").alias("a"), V(b).cast("double").alias("b"))
    finite = F.coalesce((F.abs("a") < float("inf")) & (F.abs("b") < float("inf")) & ~F.isnan("a") & ~F.isnan("b"), F.lit(False))
    good = own.filter(finite).withColumns({c: V(c) + F.lit(0.0) for c in "ab"})
    places = written(_places(good, "a", "b", eps, scale), "places")
    dense = places.groupBy("cx", "cy").agg(F.sum("n").alias("total")).filter(V("total") >= min_samples).select("cx", "cy")
    sparse = places.join(dense, ["cx", "cy"], "left_anti").select(*places.columns)
    near = _near(sparse.select("a", "b", "x", "y", "cx", "cy"), places)
    counted = near.groupBy("p.a", "p.b").agg(F.sum("n").alias("total")).filter(V("total") >= min_samples).select("a", "b")
    core = written(places.join(dense, ["cx", "cy"], "left_semi").select(*places.columns).unionByName(sparse.join(counted, ["a", "b"], "left_semi").select(*places.columns)), "core")
    nodes = written(core.groupBy("cx", "cy").agg(F.min("least").alias("node")), "nodes")
    edges = _links(core)
    for s in "pq":
        edges = edges.join(nodes.select(V("cx").alias(f"{s}x"), V("cy").alias(f"{s}y"), V("node").alias({"p": "u", "q": "v"}[s])), [f"{s}x", f"{s}y"])
    roots = components(nodes, edges.select("u", "v"))
    rooted = written(core.join(nodes, ["cx", "cy"]).join(roots, "node").select("a", "b", "x", "y", "cx", "cy", "root"), "rooted")
    rest = sparse.join(counted, ["a", "b"], "left_anti").select("a", "b", "x", "y", "cx", "cy")
    border = _near(rest, rooted).groupBy("p.a", "p.b").agg(F.min("root").alias("root")).select("a", "b", "root")
    labels = rooted.select("a", "b", "root").unionByName(border)
    joined = dealt_join(own.withColumn("finite", finite).withColumns({c: V(c) + F.lit(0.0) for c in "ab"}), labels, ["a", "b"], "left")
    return joined.select(V("id").alias(id_col), F.when(V("finite"), F.coalesce("root", F.lit(-1).cast("long"))).alias("cluster"))
