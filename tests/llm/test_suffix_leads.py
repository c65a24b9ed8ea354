"""Suffixes that share a 32-byte lead but not their grams, dealt to several buckets."""

from __future__ import annotations

import random
import string

from millrace.llm import suffix_dedup
from tests.llm.test_brute_force import DOCS, brute_repeats


def test_grams_after_one_lead(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 8)
    rng = random.Random(17)
    noise = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    rows = []
    for k in range(120):  # each passage stands in two documents, between different words
        passage = "-" * 49 + noise(58)
        rows += [(2 * k + i, noise(70) + passage + noise(70)) for i in range(2)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), length=100).collect()
    want = brute_repeats(rows, 100)
    assert sum(r[2] > 0 for r in want) == len(rows)
    assert sorted(map(tuple, got), key=repr) == want
