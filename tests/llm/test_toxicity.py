"""Toxicity features: rates do not depend on how often a text is repeated."""

import pytest

from scanweave.llm import toxicity


@pytest.mark.parametrize("sentence", ["YOU ARE A ROTTEN LIAR AND EVERYBODY KNOWS IT ", "You Are A Rotten Liar And Everybody Knows It ", "Ünd ICH sage: NEIN "])
def test_capitals_keep_their_rate_at_every_length(sentence):
    at = toxicity.NAMES.index("capitals")
    once = toxicity.features(sentence, {}, {})[at]
    assert once == sum(map(str.isupper, sentence)) / sum(map(len, toxicity._TOKEN.findall(sentence)))
    for n in (40, 150, 1000):
        assert toxicity.features(sentence * n, {}, {})[at] == pytest.approx(once)
