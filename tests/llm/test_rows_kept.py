"""No row is lost or doubled where ids repeat, stand in several sources, or an index is opened again."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, similar, topk
from tests.llm.test_brute_force import DOCS


def test_mixed_documents_follow_the_mix(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{k}") for i in range(120) for k in range(3) if (i + k) % 4] + [(7, None, "s0"), (None, "a b", None), (None, "a b", "s1")]
    docs = spark.createDataFrame(rows, DOCS + ", source string").withColumns({"__id": F.lit(1), "__Times": F.lit("x")})
    want = {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    there = {}
    for r in got.collect():
        size = len(r["text"].split())
        there[r["doc_id"], r["source"], size] = there.get((r["doc_id"], r["source"], size), 0) + size
    assert there == {k: v for k, v in want.items() if v}


def test_near_duplicates_keep_shared_ids_apart(spark):
    rows = [(1, "one two three four five six seven"), (1, "eight nine ten eleven twelve thirteen"), (None, "a b c d e f g"), (None, "h i j k l m n o")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"__k0": F.lit(1), "__keep": F.lit(2)})
    got = similar.distinct_documents(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (r["text"] for r in got.collect()))) == sorted(t for _, t in rows)


def test_index_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], DOCS)
    exact_dedup.deduplicate(first, exact_dedup.DigestIndex(spark, path, buckets=2), "one").collect()
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    second = spark.createDataFrame([(9, "a"), (8, "c")], DOCS)
    want = {(9, 2, 3, False), (8, 8, 1, True)}
    rows = lambda df: {tuple(r)[:4] for r in df.collect()}
    assert rows(exact_dedup.deduplicate(second, again, "two")) == want
    third = exact_dedup.DigestIndex(spark, path)
    assert rows(exact_dedup.deduplicate(second, third, "two")) == want  # a retry
    third.compact()
    assert len(third.tables()) == 1
    assert {(r["keep_id"], r["batch"]) for r in exact_dedup.DigestIndex(spark, path).entries().collect()} == {(2, "one"), (3, "one"), (8, "two")}
    assert rows(exact_dedup.deduplicate(second, exact_dedup.DigestIndex(spark, path), "two")) == want
    assert rows(exact_dedup.deduplicate(spark.createDataFrame([(5, "B")], DOCS), exact_dedup.DigestIndex(spark, path), "three")) == {(5, 3, 2, False)}


def test_table_goes_through_the_anti_join(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    rows = [(i, f"t{i % 7}") for i in range(40)] + [(None, "t1"), (None, "only null")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate_table(spark.createDataFrame(rows, DOCS), index, batches=3).collect()}
    size = {t: sum(x == t for _, x in rows) for _, t in rows}
    keep = {t: max((i for i, x in rows if x == t and i is not None), default=None) for _, t in rows}
    assert got == {(i, keep[t], size[t], i == keep[t]) for i, t in rows}
    assert len(index.tables()) == 3
    groups = exact_dedup.grouped(spark.createDataFrame([(1, "x")], "doc_id long, digest string"))
    plan = groups.join(index.tables()[0].select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "LeftAnti" in plan
    assert plan.count("Exchange hashpartitioning(digest") == 1  # the index's side is read in its buckets


def test_topk_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_A_TASK", 1)
    monkeypatch.setattr(topk, "SHARDS_A_TASK", 1)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SHARD_BLOCK", 5)
    rows = [(i, [((i * 37) % 11) / 8, ((i * 17) % 13) / 8 - 0.5]) for i in range(60)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(base, base.where("vec_id % 4 = 0"), k=3).collect())
    v = {i: [int(256 * x // 1) for x in e] for i, e in rows}
    want = []
    for i in v:
        if i % 4 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[i], v[j], strict=True)), j) for j in v if j != i)[:3]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
