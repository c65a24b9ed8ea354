"""Every training word has its own bigrams, also those that are not broadcast."""

from __future__ import annotations

import pytest

from millrace.llm import katz
from millrace.llm.common import id_crc
from tests.llm.test_brute_force import DOCS, brute_katz, katz_rows


@pytest.mark.parametrize("partition", [katz.PARTITION, 500])
@pytest.mark.parametrize("vocabulary", [0, 40])
def test_words_beyond_the_broadcast(spark, sf_dir, monkeypatch, partition, vocabulary):
    monkeypatch.setattr(katz, "PARTITION", partition)
    rows = katz_rows(spark, sf_dir)
    got = katz.score_texts(spark.createDataFrame(rows, DOCS), id_crc("doc_id") % 7 == 2, vocabulary=vocabulary).collect()
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, got)), key=repr) == brute_katz(rows, katz.VOCABULARY)
