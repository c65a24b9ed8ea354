"""Near-duplicates by shingle similarity, against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from millrace.llm import similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def shingles(text, words=5):
    w = WORD.findall((text or "").lower())
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or both >= similarity * all_ - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, edits):
    w = list(words)
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"x{rng.randrange(10**6)}"
    return w


def corpus(rng, bases=12, copies=14):
    vocabulary = [f"w{i}" for i in range(800)]
    rows = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.randrange(60, 300))
        rows.append(base)
        for _ in range(copies):  # from few edits to more than the similarity allows
            rows.append(edited(rng, base, rng.randrange(1, max(2, len(base) // 22))))
    rows += [rng.choices(vocabulary, k=rng.randrange(1, 200)) for _ in range(80)]
    rng.shuffle(rows)
    return [(i * 3 + 1, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("bucket", [2048, 6])
def test_components_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(similar, "BUCKET", bucket)
    rows = corpus(random.Random(11))
    rows += [(-5, None), (-3, " \t "), (9000, "one two"), (9001, "ONE  two"), (None, "one two"), (9002, "one two three four"), (9002, "one two three four")]
    got = similar.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_real_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = brute(rows)
    kept = similar.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, c in expected if d == c)


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], DOCS + ", node string, n int")
    assert similar.distinct_documents(none).collect() == []
    some = spark.createDataFrame([(1, None, "a", 1), (None, "a b", "b", 2)], DOCS + ", node string, n int")
    assert len(similar.distinct_documents(some).collect()) == 2


def test_forest_keeps_the_best_edges(monkeypatch):
    monkeypatch.setattr(similar, "BEST", 0)
    rng = np.random.default_rng(3)
    fps = np.zeros(40, np.uint64)
    samples = rng.integers(0, 2, (40, 100), dtype=np.uint8)
    a, b, equal = similar.forest(fps, samples, 0)
    assert len(a) == 39
    share = (samples[:, None] == samples[None]).sum(2)
    # Prim's algorithm on the whole graph gives the same total
    inside, total = {0}, 0
    while len(inside) < 40:
        w, j = max((share[i, j], j) for i in inside for j in range(40) if j not in inside)
        inside.add(j)
        total += w
    assert equal.sum() == total
