"""Pairs that the estimates pass over are decided by their exact similarity."""

from __future__ import annotations

import random

import pytest

from millrace.llm import similar
from tests.llm.test_similar import DOCS, brute, corpus


@pytest.mark.parametrize("bucket", [2048, 6])
def test_estimates_lose_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(similar, "BUCKET", bucket)
    monkeypatch.setattr(similar, "SLACK", -0.15)  # only pairs with 95 of 100 equal samples are proposed
    rows = corpus(random.Random(5))
    got = similar.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == brute(rows)
