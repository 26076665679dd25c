"""What grows with the tables stays out of broadcasts, and work is dealt over as many tasks as it takes."""

import contextlib
import io

import pytest

from scanweave import tables
from scanweave.operators import grids
from scanweave.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_crystals_are_searched_without_joins(spark):
    plan = plan_of(QUERIES["omega_offsets"](spark, SF_DIR))
    assert "Broadcast" not in plan and "Join" not in plan and "Window" not in plan


def test_tiles_are_not_broadcast(spark):
    plan = plan_of(QUERIES["mosaic_positions"](spark, SF_DIR))
    assert "Broadcast" not in plan


def test_rows_that_make_much_work_are_dealt_over_tasks(spark):
    rows = spark.range(1000).coalesce(1)
    assert tables.dealt(rows, most=100).rdd.getNumPartitions() == 10
    assert tables.dealt(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    met = tables.dealt(rows.withColumn("k", rows["id"] % 7), "k", most=100).groupBy("k").count()
    assert plan_of(met).count("Exchange") == 1 and met.count() == 7


@pytest.mark.parametrize("name", ["reflections", "reflection_families", "fit_spots", "fit_on_decay", "fit_two_gaussians", "fit_two_lorentzians"])
def test_parts_are_dealt_before_they_are_drawn(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["contiguous_runs", "grid_axes", "grid_points", "positions_table"])
def test_whole_scans_are_dealt_by_their_rows(spark, name):
    """Their number of tasks follows the rows: no shuffle is left to a fixed number of partitions, and none is joined by one motor's cells."""
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_scans_too_long_for_a_task_give_the_same_grid(spark, monkeypatch):
    frames = spark.range(4000).selectExpr("id % 3 AS scan", "id AS frame", "floor(id / 90) % 9 + id * 7919 % 1000 / 1e6 AS slow", "id % 30 + id * 7907 % 1000 / 1e6 AS fast")
    found = []
    for most in (1 << 19, 100):
        monkeypatch.setattr(grids, "dealt_groups", lambda rows, *keys, most=most: tables.dealt_groups(rows, *keys, most=most))
        grid = grids.detect(frames, ("slow", "fast"), "frame", by=("scan",))
        assert (grid.tasks is None) == (most == 100)
        rows = [grid.points.drop("slow", "fast"), grid.axes.selectExpr("scan", "motor", "index", "round(centre, 9)", "n"), grid.dims, grid.positions(), grid.holes(), grid.summary()]
        found.append([sorted(map(tuple, df.collect())) for df in rows])
    assert found[0] == found[1] and all(found[0][:4])
