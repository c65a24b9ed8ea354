"""A corpus pipeline: five stages, each a pass of one operator over what the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
rows as Parquet to the shared folder and reads them as the next one's documents. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, langid, mixing, sentencepiece_codec, similar
from millrace.llm.common import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language stay; those it rejects (no text, or no letter) go."""
    model = langid.train(docs)
    if not model.labels:  # nothing to learn from: the letters alone decide
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model)
    return found.where(F.col("lang_pred") != langid.UND).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest id stays."""
    return exact_dedup.kept_documents(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose fingerprints differ in at most two bits, or with a similarity of 0.8 or more
    (five-word shingles), the one with the least id stays."""
    return similar.distinct_documents(docs, tau=2).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, input_ids and n_tokens of every document."""
    return sentencepiece_codec.encode(docs, keep=["doc_id", "source"])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("sentencepiece", encoding),
]

#: SQL can express neither the language model, the fingerprints nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
