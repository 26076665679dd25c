"""The pipeline's line stage: boilerplate goes from every document that has other text."""

import pytest

import corpus_pipeline
from scanweave.llm import lines


@pytest.mark.parametrize("limit", [0, 1000])
def test_boilerplate_goes_whatever_its_share(spark, limit):
    boiler = "A long notice that many sites show below whatever they print."
    rows = [(i, f"own {i}\n{boiler}\n \n{boiler}", f"s{i}", 0) for i in range(9)] + [(90, f"{boiler}\n \n{boiler}", "s1", 0), (91, None, "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(docs, shared_lines=limit).collect()}
    assert got == {i: f"own {i}\n " for i in range(9)} | {90: rows[-2][1], 91: None}
    stage = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert stage[3] == ("own 3\n ", 7) and stage[90][0] == rows[-2][1]
