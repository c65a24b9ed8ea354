"""Operators with SQL: edge cases, and the pipeline against plain Python."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import exact_dedup, mixing, queries

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    cols = list(want.columns)
    assert got.sort_values(cols).values.tolist() == want.sort_values(cols).values.tolist()


def test_dedup_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    first = spark.createDataFrame([(1, "A b", "s"), (2, "a B", "s"), (3, None, "s"), (4, "", "s"), (None, "a b", "s"), (5, "é", "s")], DOCS).withColumn("digest", F.lit(0))
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(first, index, "one").collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True)}
    again = {(r["doc_id"], r["kept"]) for r in exact_dedup.deduplicate(first, index, "one").collect()}
    assert again == {(1, False), (2, True), (None, False), (3, False), (4, True), (5, True)}
    second = spark.createDataFrame([(9, "A B", "s"), (8, "É", "s"), (7, "É", "s")], DOCS)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(second, index, "two").collect()}
    assert got == {(9, 2, 4, False), (8, 8, 2, True), (7, 8, 2, False)}
    assert exact_dedup.deduplicate(second.limit(0), index, "three").count() == 0


def test_kept_documents_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (1, "x", "a"), (2, "y", "a"), (None, "z", "b")], DOCS).withColumn("digest", F.lit("q"))
    got = exact_dedup.kept_documents(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "z"), (1, "x"), (2, "y")]


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 7), None if i % 5 == 0 else f"s{i % 3}") for i in range(200)] + [(3, "w w", "s0"), (None, "w w w", "s1"), (900, None, "s2"), (901, "  ", "only-empty")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 6
        assert rs[0]["target"] <= 2 * rs[0]["source_size"] + 1e-9
    total = sum(r["size"] for r in got)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * total) < 1e-6
    assert sorted(map(repr, mixing.mix(docs.repartition(5)).collect())) == sorted(map(repr, got))
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert copies.where("doc_id = 900").count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, sf_dir).cache()
        assert new.columns == columns, name
        ids = {r[0] for r in kept.select("doc_id").collect()}
        assert {r[0] for r in new.select("doc_id").collect()} <= ids
        if name == "exact_dedup":
            assert new.count() == len({(r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in kept.collect()})
        kept = new
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert len(out) == kept.count()
    assert all(len(r["input_ids"]) == r["n_tokens"] > 0 for r in out)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(out)
