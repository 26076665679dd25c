"""The queries that SQL can express, against DuckDB on the smallest tables; and that no mask misses an overlap."""

import itertools

import duckdb
import pytest

from scanweave.llm import decontaminate, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF_DIR).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("size", range(1, 16))
def test_some_mask_keeps_clear_of_any_differing_tokens(size):
    width = min(size, decontaminate.WINDOW)
    need = (4 * width + 4) // 5
    for differing in itertools.combinations(range(width), width - need):
        kept = [{k for k, c in enumerate(decontaminate.MASKS[m]) if c == "1"} for m in decontaminate.masks_of(size)]
        lengths = [len(decontaminate.MASKS[m]) for m in decontaminate.masks_of(size)]
        assert any(not {s + k for k in own} & set(differing) for own, n in zip(kept, lengths, strict=True) for s in range(width - n + 1))
