"""Grids and density clusters against plain versions, with jitter, holes, repeats, hot cells and odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave import tables
from scanweave.operators import clusters, components, grids


def grid_frames(seed, n_slow, n_fast, snake, drop=()):
    """Readbacks of a raster with noise of a fiftieth of a step; a few frames are missing and the last one is repeated."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n_slow):
        for j in range(n_fast):
            x = n_fast - 1 - j if snake and i % 2 else j
            if (i, x) not in drop:
                rows.append((len(rows), i * 0.5 + r.uniform(-0.01, 0.01) * 0.02, 10.0 - x * 0.1 + r.uniform(-0.01, 0.01) * 0.02, i, n_fast - 1 - x))
    rows.append((len(rows), *rows[-1][1:]))
    return rows


@pytest.mark.parametrize("snake", [False, True])
@pytest.mark.parametrize("block", [4, 1 << 16])
def test_grid_of_a_raster(spark, snake, block):
    drop = {(0, 3), (4, 0), (4, 1)}
    rows = grid_frames(1, 6, 9, snake, drop)
    frames = spark.createDataFrame([r[:3] for r in rows], "frame long, chi double, mu double")
    grid = grids.detect(frames, ("mu", "chi"), "frame", block=block)
    got = {r["frame"]: (r["chi_index"], r["mu_index"]) for r in grid.points.collect()}
    assert got == {r[0]: r[3:] for r in rows}
    dims = {r["motor"]: (r["dim"], r["size"]) for r in grid.dims.collect()}
    assert dims == {"chi": (0, 6), "mu": (1, 9)}
    changed = {r["motor"]: r["changes"] for r in grid.dims.collect()}
    assert changed == {m: sum(a[k] != b[k] for a, b in zip(rows, rows[1:], strict=False)) for m, k in (("chi", 3), ("mu", 4))}
    assert {(r["chi_index"], 8 - r["mu_index"]) for r in grid.holes().collect()} == drop
    assert tuple(grid.summary().first()) == (54, 51, 3, 1)
    centres = {r["frame"]: r["value"] for r in grid.motor_values("mu", readback=False).collect()}
    assert all(abs(centres[r[0]] - r[2]) < 5e-4 for r in rows) and len(centres) == len(rows)


def test_gaps_equal_to_the_tolerance_and_missing_values(spark):
    values = [0.0, 1.0, 2.0, 3.5, 4.5, float("nan"), None, -7.0, -6.0]
    frames = spark.createDataFrame([(k, v, 5.0, "s") for k, v in enumerate(values)], "frame long, a double, b double, scan string")
    grid = grids.detect(frames, ("a", "b"), "frame", tolerance={"a": 1.0}, order=("b", "a"), by=("scan",))
    assert {r["frame"]: (r["b_index"], r["a_index"]) for r in grid.points.collect()} == {0: (0, 1), 1: (0, 1), 2: (0, 1), 3: (0, 2), 4: (0, 2), 7: (0, 0), 8: (0, 0)}
    assert {(r["motor"], r["dim"], r["size"]) for r in grid.dims.collect()} == {("b", 0, 1), ("a", 1, 3)}
    empty = grids.detect(frames.limit(0), ("a", "b"), "frame", by=("scan",))
    assert empty.points.count() == empty.dims.count() == empty.holes().count() == 0


def test_split_layer_and_part_of_a_grid(spark):
    series = spark.createDataFrame([(k, k, k % 2) for k in range(10)], "frame long, step_index int, c_index int")
    got = {r["frame"]: (r["a_index"], r["b_index"]) for r in grids.split(series, "step", {"a": 3, "b": 4}, snake=True).collect()}
    order = np.arange(12).reshape(3, 4)
    order[1] = order[1, ::-1].copy()
    assert got == {int(order[i, j]): (i, j) for i in range(3) for j in range(4) if order[i, j] < 10}
    with pytest.raises(Exception, match="no room"):
        grids.split(series, "step", {"a": 3, "b": 3}).collect()
    with pytest.raises(ValueError, match="new names"):
        grids.split(series, "step", {"c": 10})
    assert [r["frame"] for r in grids.layer(series, "c", 1).collect()] == [1, 3, 5, 7, 9]
    part = grids.sub(series, {"step": (2, 5)}).collect()
    assert [(r["frame"], r["step_index"]) for r in part] == [(2, 0), (3, 1), (4, 2)]
    full = grids.from_grid(series.select("frame"), "frame", {"z": 2, "x": 5})
    assert {r["frame"]: (r["z_index"], r["x_index"]) for r in full.collect()} == {k: divmod(k, 5) for k in range(10)}


def reference_clusters(xy, eps, least):
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    root = np.full(len(xy), -1)
    for k in range(len(xy)):
        if core[k] and root[k] < 0:
            todo, root[k] = [k], k
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (root < 0)):
                    root[j] = k
                    todo.append(j)
    out = root.copy()
    for k in np.flatnonzero(~core):
        some = root[near[k] & core]
        out[k] = some.min() if len(some) else -1
    return out.tolist()


def shapes(name):
    r = np.random.default_rng(7)
    if name == "blobs and noise":
        return np.concatenate([r.normal(c, 0.3, (120, 2)) for c in ((0, 0), (1.4, 0), (4, 4))] + [r.uniform(-3, 7, (80, 2))])
    if name == "whole numbers":
        return r.integers(0, 25, (400, 2)).astype(float)
    if name == "two hot cells apart":  # each fits into one cell, their gap is just over or under eps
        left = r.uniform(0, 0.2, (300, 2))
        return np.concatenate([left, left + (1.19, 0), left + (0, 40), left + (1.21, 40)])
    if name == "one place":
        return np.concatenate([np.zeros((300, 2)), [[0.5, 0.5]], [[9.0, 9.0]], r.uniform(20, 60, (50, 2))])
    return np.stack([np.arange(300) * 0.9, np.zeros(300)], axis=1)  # a chain


@pytest.mark.parametrize(("name", "eps", "least"), [("blobs and noise", 0.35, 5), ("whole numbers", 1.0, 4), ("whole numbers", 2.0, 11), ("two hot cells apart", 1.0, 5), ("one place", 1.0, 5), ("chain", 1.0, 3)])
def test_density_clusters_equal_all_pairs(spark, name, eps, least, monkeypatch):
    monkeypatch.setattr(clusters, "SMALL_BOX", 4)
    xy = shapes(name)
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in clusters.dbscan(points, "id", "a", "b", eps, least, scale=False).collect()}
    assert [got[k] for k in range(len(xy))] == reference_clusters(xy, eps, least)


def test_density_clusters_of_scaled_and_odd_values(spark):
    r = np.random.default_rng(3)
    xy = np.concatenate([r.normal(0, 1, (150, 2)) * (5, 300), [[60, 0]]])
    rows = [(k, float(x), float(y), "z") for k, (x, y) in enumerate(xy)] + [(900, None, 1.0, "z"), (901, float("nan"), 1.0, "z"), (902, 1.0, float("inf"), "z")]
    points = spark.createDataFrame(rows, "id long, a double, b double, cx string")
    got = {r["id"]: r["cluster"] for r in clusters.dbscan(points, "id", "a", "b", 0.3, 4).collect()}
    scaled = (xy - xy.mean(0)) / xy.std(0)
    assert [got.pop(k) for k in range(len(xy))] == reference_clusters(scaled, 0.3, 4)
    assert got == {900: None, 901: None, 902: None}
    assert clusters.dbscan(points.limit(0), "id", "a", "b").collect() == []
    still = spark.createDataFrame([(k, 1.0, -0.0 if k % 2 else 0.0) for k in range(8)], "id long, a double, b double")
    assert {r["cluster"] for r in clusters.dbscan(still, "id", "a", "b").collect()} == {0}


def test_components_of_chains_hubs_and_lone_nodes(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 4), (4, 3)]
    nodes = spark.range(0, 150).withColumnRenamed("id", "node")
    got = {r["node"]: r["root"] for r in components.components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 if k <= 30 else 100 if 100 <= k < 140 else k for k in range(150)}
    assert components.components(nodes.limit(0), spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dealt_joins_equal_plain_ones(spark, how):
    wide = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)] + [(None, 1)], "key long, v long")
    narrow = spark.createDataFrame([(0, "a"), (0, "b"), (95, "c"), (7, "d"), (None, "e")], "key long, w string")
    plain, dealt = wide.join(narrow, ["key"], how), tables.dealt_join(wide, narrow, ["key"], how, most=4)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.select(*plain.columns).collect()))
    assert dealt.filter(F.col("key") == 0).count() == plain.filter(F.col("key") == 0).count()
