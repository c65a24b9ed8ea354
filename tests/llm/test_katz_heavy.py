"""Bigrams that hold much of the text are dealt over the partitions by document; the model stays the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.llm import katz
from millrace.llm.common import id_crc
from tests.llm.test_brute_force import DOCS, brute_katz


@pytest.mark.parametrize("partition", [katz.PARTITION, 40])
def test_pair_with_a_third_of_all(spark, monkeypatch, partition):
    monkeypatch.setattr(katz, "PARTITION", partition)
    rows = [(i, " ".join(["of the"] * (i % 5) + [f"w{i % 7}", "a", f"rare{i}"] + ["the end"] * (i % 3))) for i in range(60)]
    rows += [(100, None), (101, "of the of the"), (101, "of the of the"), (None, "the")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    held = id_crc("doc_id") % 7 == 2
    want = brute_katz(rows, katz.VOCABULARY)
    for vocabulary in (katz.VOCABULARY, 4):
        got = katz.score_texts(docs, held, vocabulary=vocabulary, sampled=1, heavy=20).collect()
        assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, got)), key=repr) == want


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    katz.score_texts(spark.createDataFrame([(1, "a b")], DOCS), F.lit(False)).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
