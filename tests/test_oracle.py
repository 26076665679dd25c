"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from scanweave.plans.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return c


def plain(value):
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return None if isinstance(value, float) and math.isnan(value) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    relation = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    place = [relation.columns.index(c) for c in columns]
    got, want = ordered(df.select(*[f"`{c}`" for c in columns]).collect()), ordered([[r[i] for i in place] for r in relation.fetchall()])
    assert len(got) == len(want) and got
    for g, w in zip(got, want, strict=True):
        assert all(map(same, g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
