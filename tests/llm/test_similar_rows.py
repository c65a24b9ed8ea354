"""Rows whose ids are null or shared, in components of their own."""

from __future__ import annotations

from millrace.llm import similar

COLS = "doc_id long, text string, source string"


def test_one_row_of_each_component(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "r"), (7, c, "s"), (7, d, "s"), (7, d, "s"), (None, d, "s"), (9, e, "s"), (8, e, "s")]
    want = sorted([(None, a), (None, b), (7, c), (7, d), (8, e)], key=repr)
    both = []
    for given, parts in ((rows, 1), (rows[::-1], 5)):
        kept = similar.distinct_documents(spark.createDataFrame(given, COLS).repartition(parts)).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == want
        both.append(sorted(map(repr, kept)))
    assert both[0] == both[1]
