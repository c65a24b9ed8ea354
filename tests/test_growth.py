"""Searches, BM25 and packing: what is exchanged grows no faster than the input, and odd rows keep their results."""

from __future__ import annotations

import math
import random
import re

import pytest

from millrace.operators import packing, retrieval


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in (*a, *b):
        return None
    dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
    x = dot(a, b) / max(math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)), 1e-12)
    return x if math.isnan(x) else round(x, 6) + 0.0


def test_cosine_topk(spark):
    rng = random.Random(5)
    vectors = [[rng.choice([-1.0, 0.0, 0.5, 3.0]) for _ in range(3)] for _ in range(60)] + [[0.0] * 3, None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, 2.0], []]
    rows = [(f"v{i:02}", v) for i, v in enumerate(vectors)]
    rows += [("v01", [3.0, 0.0, 0.5]), (None, [1.0, 1.0, 1.0])]  # a repeated and a null id
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(5)
    want = set()
    for q in {i for i, _ in rows if i}:
        scored = [(cosine(a, b), j) for i, a in rows if i == q for j, b in rows if j is not None and j != q]
        scored.sort(key=lambda x: (x[0] is None, x[0] is not None and not math.isnan(x[0]), -(x[0] or 0.0) if x[0] == x[0] else 0.0, x[1]))
        want |= {(q, j, repr(s), n + 1) for n, (s, j) in enumerate(scored[:7])}
    found = retrieval.cosine_topk(df, df, "id", "id", "v", 7)
    got = [(r["id"], r["match_id"], repr(r["score"]), r["rank"]) for r in found.collect()]
    assert len(got) == len(want)
    assert set(got) == want
    assert "zip_with" not in plan(found)  # blocks are multiplied, not pairs of rows one by one


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_bm25(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW_TERMS", few, raising=False)  # 0: as for queries too many to broadcast
    texts = {1: "a b b c", 2: "", 3: None, 4: "x y z B", 5: "--c--c", 6: "nothing"}
    queries = {"q1": "A b", "q2": "c c", "q3": "", "q4": None, "q5": "absent x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(3)
    found = retrieval.bm25(docs, spark.createDataFrame(list(queries.items()), "qid string, q string"), "doc_id", "text", "qid", "q")
    words = {i: re.findall("[a-z]+", (t or "").lower()) for i, t in texts.items()}
    avg = sum(map(len, words.values())) / len(words)  # null texts are documents of length 0, as in SQL
    want = {}
    for q, text in queries.items():
        for term in {*re.findall("[a-z]+", (text or "").lower())}:
            df = sum(term in w for w in words.values())
            for i, w in words.items():
                if tf := w.count(term):
                    want[q, i] = want.get((q, i), 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
    got = {(r["qid"], r["doc_id"]): r["score"] for r in found.collect()}
    assert got == pytest.approx(want, abs=1e-12)
    if few:  # nothing but the texts goes by document
        assert len(re.findall(r"Exchange hashpartitioning\(.*doc_id", found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])) == 1


def test_packed(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g, n in (("a", 40), ("b", 3), (None, 25), ("empty", 2)):
        all_ = []
        for o in [None, *range(n)]:
            t = None if o == 1 else [rng.randrange(99) for _ in range(0 if g == "empty" else rng.choice([0, 1, 2, 7, 40]) if g != "b" else 1)]
            rows.append((g, o, t))
            all_ += t or []
        kept = all_ if len(all_) < 8 else all_[: len(all_) // 8 * 8]
        want |= {(g, i // 8): kept[i : i + 8] for i in range(0, len(kept), 8)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, t array<int>").repartition(4)
    found = packing.packed(df, "g", "o", "t", 8)
    assert {(r["g"], r["block_no"]): r["tokens"] for r in found.collect()} == want
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in shown  # slices go to their blocks, not tokens one by one
    twins = spark.createDataFrame([("g", 1, [1, 2, 3]), ("g", 1, [1, 2, 3]), ("g", 1, [4]), ("g", 2, [5])], "g string, o int, t array<int>")
    got = [x for r in packing.packed(twins, "g", "o", "t", 2).orderBy("block_no").collect() for x in r["tokens"]]
    assert got in ([1, 2, 3, 1, 2, 3, 4, 5], [4, 1, 2, 3, 1, 2, 3, 5])  # an order that repeats loses no row
