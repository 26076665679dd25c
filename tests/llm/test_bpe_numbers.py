"""More dictionaries in a task than it has numbers for are an error, as many as that are not."""

import public_tokenizers
import pytest

from scanweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [4, 5])
def test_a_task_never_takes_the_next_ones_numbers(spark, n, monkeypatch):
    monkeypatch.setattr(bpe, "NUMBER_BITS", 2)
    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(2 * n)], "doc_id long, text string").coalesce(1)
    own = docs.select("doc_id", "text").repartitionByRange(2, "doc_id")
    if n == 4:
        assert sorted(r["dictionary"] for r in bpe.dictionaries(own, chars=1).select("dictionary").collect()) == list(range(8))
    else:
        with pytest.raises(Exception, match="more than 4 dictionaries"):
            bpe.dictionaries(own, chars=1)
