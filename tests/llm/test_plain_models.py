"""Language mixtures, toxicity trees and token counts against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid, sentencepiece_codec, token_counts, toxicity
from tests.llm.test_brute_force import DOCS, TEXTS, read


def plain_bucket(a, b, c):
    h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ ((c * 0xC2B2AE3D + 0x27D4EB2F) & 0xFFFFFFFF)
    h ^= h >> 15
    return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - langid.BITS)


def plain_words(text):
    """Bucket lists of the words (runs of letters) of a text."""
    out = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        if word.isalpha():
            cps = [0, *map(ord, word), 0]
            out.append([plain_bucket(*cps[i - 1 : i + 2]) for i in range(1, len(cps) - 1)])
    return out


def plain_language(words, labels, logp):
    """The language and its share: EM over the words, sets of languages by penalised likelihood."""
    like = [[sum(logp[x][b] for b in w) for x in labels] for w in words]
    like = [[math.exp(max(v - max(row), -60)) for v in row] for row in like]

    def em(mix, times):
        for _ in range(times):
            total = [0.0] * len(mix)
            for row in like:
                r = [a * m for a, m in zip(row, mix, strict=True)]
                for k, v in enumerate(r):
                    total[k] += v / sum(r)
            mix = [t / len(like) for t in total]
        return mix

    mix = em([1 / len(labels)] * len(labels), langid.EM_STEPS)
    alone = [sum(math.log(max(row[k], 1e-30)) for row in like) for k in range(len(labels))]
    best, final = max(alone), [float(k == alone.index(max(alone))) for k in range(len(labels))]
    order = sorted(range(len(labels)), key=lambda k: -mix[k])
    for m in range(2, len(labels) + 1):
        part = [mix[k] + 1e-9 if k in order[:m] else 0.0 for k in range(len(labels))]
        part = em([p / sum(part) for p in part], langid.REFIT_STEPS)
        ll = sum(math.log(max(sum(a * p for a, p in zip(row, part, strict=True)), 1e-30)) for row in like) - 0.5 * (m - 1) * math.log(len(like) + 1)
        if ll > best:
            best, final = ll, part
    return labels[final.index(max(final))], max(final)


def test_language_id_against_plain_em(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("length(text) < 3000").limit(70).collect()]
    mixed = [t for _, t, _ in rows[:4]]
    rows += [(9000 + i, f"{a} {b}", None) for i, (a, b) in enumerate(zip(mixed, mixed[1:], strict=False))] + [(9100, "12 !", "en"), (9101, None, "fr")]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    counts = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and not out(i):
            table = counts.setdefault(lang, {})
            for w in plain_words(t):
                for b in w:
                    table[b] = table.get(b, 0) + 1
    labels = sorted(counts)
    seen = len({b for t in counts.values() for b in t})

    class Log(dict):
        def __init__(self, table):
            super().__init__({b: math.log((n + langid.SMOOTHING) / (sum(table.values()) + langid.SMOOTHING * seen)) for b, n in table.items()})
            self.rest = math.log(langid.SMOOTHING / (sum(table.values()) + langid.SMOOTHING * seen))

        def __missing__(self, b):
            return self.rest

    logp = {x: Log(counts[x]) for x in labels}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, ~held).collect()}
    for i, t, _ in rows:
        words = plain_words(t or "")
        want = plain_language(words, labels, logp) if words else ("und", 0.0)
        assert got[i][0] == want[0], i
        assert abs(got[i][1] - want[1]) < 2e-3, i


def plain_isotonic(x, y):
    """Fitted values by the minimax formula: at k, the largest over i <= k of the least mean of y[i..j], j >= k."""
    order = np.argsort(x, kind="stable")
    y = y[order]
    mean = lambda i, j: y[i : j + 1].mean()
    return x[order], np.array([max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))])


def test_isotonic_against_the_minimax_formula():
    rng = np.random.default_rng(4)
    x = rng.permutation(40).astype(float)
    y = (rng.random(40) < x / 40).astype(float)
    knots, values = toxicity.isotonic(x, y)
    at, fit = plain_isotonic(x, y)
    blocks = {v: int((np.abs(fit - v) < 1e-12).sum()) for v in fit}
    smooth = [(v * blocks[v] + 0.5 * y.mean()) / (blocks[v] + 0.5) for v in fit]
    assert np.allclose(np.interp(at, knots, values), np.maximum.accumulate(smooth))


def plain_margin(trees, row):
    total = trees.base
    for tree in trees.trees:
        while isinstance(tree, tuple):
            j, cut, left, right = tree
            tree = left if sum(e <= row[j] for e in trees.edges[j]) <= cut else right
        total += tree
    return total


def test_trees_against_plain_walks_and_splits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(300) < 0.1)).astype(float)
    trees = toxicity.Trees().fit(x, y)
    assert np.allclose(trees.margins(x[:50]), [plain_margin(trees, r) for r in x[:50]])
    # the first split is the best of all cuts of all features
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = None
    for j in range(3):
        bins = np.array([sum(e <= v for e in trees.edges[j]) for v in x[:, j]])
        for cut in range(len(trees.edges[j])):
            left = bins <= cut
            if min(left.sum(), (~left).sum()) >= toxicity.LEAF:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
                if best is None or gain > best[0] + 1e-9:
                    best = gain, j, cut
    assert trees.trees[0][:2] == best[1:]


def test_toxicity_query_against_plain_scores(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    assert model.trees is not None
    rows = docs.where("length(text) < 4000").limit(150).unionByName(docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(-1)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    words = toxicity.Lexicon(model.lexicon)
    for r in rows.collect():
        m = plain_margin(model.trees, toxicity.features(r["text"], words))
        k, v = model.knots
        i = int(np.searchsorted(k, m))
        want = v[0] if i == 0 else v[-1] if i == len(k) else v[i - 1] + (v[i] - v[i - 1]) * (m - k[i - 1]) / (k[i] - k[i - 1])
        assert math.isclose(got[r["doc_id"]], min(max(want, 0), 1), abs_tol=1e-9)


def plain_count(text, v):
    """Pieces of the best segmentation of each word, the longer last piece among equals."""
    total = 0
    for word in re.findall("▁*[^▁]+|▁+", "▁" + text.replace(" ", "▁")) if text else ():
        best, count = [0.0], [0]
        for j in range(1, len(word) + 1):
            c = word[j - 1]
            s, n = (best[j - 1] + v.unknown, count[j - 1] + len(c.encode())) if c not in v.by_text else (best[j - 1] + v.by_text[c][0], count[j - 1] + 1)
            for i in range(j - 2, max(-1, j - 1 - v.longest), -1):
                if word[i:j] in v.by_text and best[i] + v.by_text[word[i:j]][0] >= s:
                    s, n = best[i] + v.by_text[word[i:j]][0], count[i] + 1
            best.append(s)
            count.append(n)
        total += count[-1]
    return total


def test_token_counts_against_plain_search(spark, sf_dir):
    v = sentencepiece_codec.Vocabulary(sentencepiece_codec.read_model(spark))
    rng = random.Random(8)
    long_ = "".join(rng.choice("etaoinshr東é") for _ in range(3 * sentencepiece_codec.LONG))
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").limit(40).collect()]
    rows += [(9000 + i, t) for i, t in enumerate([*TEXTS, long_, f"a {long_} b"]) if "▁" not in t] + [(9500, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("x"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()}
    assert got == {i: plain_count(t or "", v) for i, t in rows}
    sizes = {r["doc_id"]: r["n_tokens"] for r in sentencepiece_codec.digests(docs).collect()}
    assert sizes == got


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert token_counts.token_counts(none).count() == 0
    assert sentencepiece_codec.digests(none).count() == 0
    assert toxicity.score(none, toxicity.Model({}, 0.0)).count() == 0


def test_models_with_other_settings_are_refused():
    data = open(sentencepiece_codec.DEFAULT_MODEL, "rb").read()
    import pytest

    try:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
    except Exception as e:  # the library's own proto module is not always there
        pytest.skip(str(e))
    m.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="removal of blanks"):
        sentencepiece_codec.Vocabulary(m.SerializeToString())
