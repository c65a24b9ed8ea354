"""The pipeline's near-duplicate stage links by SimHash fingerprints, and by similarity what those miss."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_brute_force import brute_fingerprint
from tests.llm.test_similar import DOCS, corpus, edited, shingles


def linked(rows, tau=2, similarity=0.8):
    """The least id of each component, and how many pairs link by fingerprints alone and by similarity alone."""
    fps, sets = [brute_fingerprint(t) for _, t in rows], [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    alone = [0, 0]
    for i in range(len(rows)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= tau
            like = len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9
            alone[0] += near and not like
            alone[1] += like and not near
            if near or like:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values()), alone


def test_stage_links_by_fingerprints_too(spark):
    rng = random.Random(8)
    texts = [t for _, t in corpus(rng, bases=6, copies=8)]
    for k in range(6):
        line = [f"l{k}x{i}" for i in range(21)]
        # a line repeated, and an end of one's own: few shingles in common, each of them often
        texts += [" ".join(line * 40 + [f"e{rng.randrange(10**9)}" for _ in range(18)]) for _ in range(5)]
        texts += [" ".join(line * 5 + edited(rng, line * 5, 1 + i)) for i in range(4)]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    want, (by_ring, by_similarity) = linked(rows)
    assert by_ring > 50
    assert by_similarity > 50
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in kept.collect()) == want
