"""Modules of plans: names bound once, so no query reads another's constants."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from scanweave.plans import placement, queries
from scanweave.plans.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [placement, queries])
def test_names_are_bound_once(module):
    bound = Counter()
    for node in ast.parse(Path(module.__file__).read_text()).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        bound.update(t.id for t in targets if isinstance(t, ast.Name))
    assert [name for name, n in bound.items() if n > 1] == []


def test_layouts_are_scored_by_their_own_rules(spark):
    names = {r["rule"] for r in QUERIES["match_layouts"](spark, SF_DIR).select("rule").distinct().collect()}
    assert names == {"numbered", "dated", "plain", "mixed"}


def test_layouts_look_into_every_parent(spark, tmp_path):
    """Two-letter names are one to sixty folders above, in the host, further down, and in a folder whose name only begins like a parent's."""
    long = "/".join(f"part{k}" for k in range(60))
    paths = ["far/en/x1", f"far/{long}/1", "far/a1/b1/c1/d1/e1/7?page=2", "mid/one/xy", "mid/one/two/three/four/five/6#top", "mid/one/two/three/four/five/6?ref=x"]
    paths += ["mid/other/two/three/four/five/8", "mid/oneself/two/three/four/five/9", "none/one/two/three/four/five/", "none/one/two/three/four/five/1", "/lone/two/three/four/five/1", "/ab", "top/", "zz"]
    spark.createDataFrame([(i, f"http://{p}", "") for i, p in enumerate(paths)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["match_layouts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(SQL["match_layouts"]).project(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    mixed = {r["folder"]: r["score"] for r in got.filter("rule = 'mixed'").collect()}
    assert mixed[f"far/{long}"] == 0.5 and mixed["mid/one/two/three/four/five"] == 1.0 and mixed["none/one/two/three/four/five"] == 0.0
