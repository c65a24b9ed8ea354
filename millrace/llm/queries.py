"""The ten operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, katz, langid, mixing, sentencepiece_codec, simhash, suffix_dedup, token_counts, topk, toxicity
from millrace.llm.common import id_crc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.pmod("vec_id", F.lit(50)) == 0), k=5, scale=256.0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = id_crc("doc_id") % 5 == 0
    found = langid.identify(docs, ~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_languages")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate_table(_table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out())
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return katz.score_texts(docs, id_crc("doc_id") % 7 == 2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_exact_topk, op2_language_id, op3_exact_dedup, op4_toxicity, op5_suffix_dedup, op6_sentencepiece, op7_token_counts, op8_mixing, op9_simhash, op10_katz, pipeline)
    return {f.__name__: f for f in ops}


#: Words as the contracts define them, for DuckDB.
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.e, b.e)::BIGINT AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id AND len(q.e) = len(b.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP3 = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, source, {_SIZE} AS size, substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
  FROM d GROUP BY source),
t AS (SELECT 1.5 * sum(source_size)::DOUBLE AS total FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS k,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
         (sum(w) OVER (ORDER BY source_size / w DESC, source DESC))::DOUBLE AS free
  FROM s WHERE source_size > 0),
l AS (SELECT arg_min((total - capped) / free, k) AS level FROM o, t WHERE (total - capped) / free * w <= 2.0 * source_size),
g AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(2.0 * source_size, w * level) END::DOUBLE AS target FROM s, l),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM g),
c AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - same <= rest AND 2 * (rest - (upto - same)) > same)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1, "op3_exact_dedup": OP3, "op8_mixing": OP8}
