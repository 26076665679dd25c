"""The corpus pipeline: its stages chained by hand give the rows of run()."""

import duckdb

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def test_run_is_the_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] >= sizes[2] > sizes[3] >= sizes[4] == sizes[5]
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))


def test_near_dedup_leaves_no_two_equal_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SF_DIR)
    assert kept.count() == kept.select("text").distinct().count()
    distinct = duckdb.sql(f"SELECT count(DISTINCT text) FROM '{SF_DIR}/documents.parquet'").fetchall()[0][0]
    assert kept.count() <= distinct
