"""Token counts against the library's own encoder."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from scanweave.llm import queries, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "\n\n", "▁x ▁▁ y", "<s> </s> <unk> <0x0A>", "\0\t\r", "漢字かな 🙂🙂", "é ﬁ Ａ", "a.b,,c!!;(d)[e]_f 12345 3.14", "don't», «x»"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def count():
    return token_counts.Counter(PATH)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, count, text):
    assert count(text) == len(library.encode(text))


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(library, count, seed):
    r = random.Random(seed)
    letters = r.choice(["ab e\n.", "the and ing  ,.!?\"'()[]", "▁ a\t\r\n_-", "漢字é\0😀 ­​　x", "0123456789. ,", "ÀÿßΩжא हि ไทย"])
    for _ in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert count(text) == len(library.encode(text)), text


@pytest.mark.parametrize("text", ["a" * 50_001, " " * 50_001, "ab" * 30_000 + " end", "x y " * 20_000, "é漢" * 20_000])
def test_very_long_texts_with_and_without_blanks(library, count, text, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 1000)
    assert count(text) == len(library.encode(text))


def test_query_equals_the_library(spark, library):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = sorted((r["doc_id"], len(t.encode()), n := len(library.encode(t)), n > 4096) for r in rows for t in [r["text"] or ""])
    got = queries.queries()["op11_token_counts"](spark, SF_DIR).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, got)) == want


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, library):
    rows = [(1, "a b", 7, True), (1, "a b", 7, True), (None, "no id", 1, False), (2, None, 2, None), (3, "", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, over_limit boolean")
    got = token_counts.token_counts(docs, PATH, limit=1)
    n = len(library.encode("no id"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 3, 2, True), (1, 3, 2, True), (None, 5, n, True), (2, 0, 0, False), (3, 0, 0, False)], key=str)
    assert token_counts.token_counts(docs.limit(0), PATH).collect() == []
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_other_kinds_of_models_are_refused(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.byte_fallback = False
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte fallback"):
        token_counts.Counter(str(tmp_path / "other.model"))
