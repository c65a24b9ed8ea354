"""Capitals count by one rule at every length."""

from __future__ import annotations

import pytest

from millrace.llm import toxicity


@pytest.mark.parametrize("text", ["ŻÓŁĆ źle", "ΑΒΓ abc", "СЛОВО слово", "ABC def ÀÉ"])
def test_share_of_capitals_at_every_length(text):
    lexicon = toxicity.Lexicon({})
    share = sum(map(str.isupper, text)) / len(text)
    for times in (1, 40):
        assert toxicity.features(text * times, lexicon)[8] == pytest.approx(share)
