"""The pipeline's language stage where no row has a language."""

from __future__ import annotations

import corpus_pipeline


def test_documents_with_letters_stay(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "Слова", None), (5, "語", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4, 5]
