"""Words, contexts and rows are told apart by hashes that no pair of texts is known to defeat."""

from __future__ import annotations

import numpy as np

from millrace.llm import katz, suffix_dedup
from millrace.llm.common import id_crc, word_hashes
from tests.llm.test_brute_force import DOCS, brute_katz, brute_repeats


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


def test_words_of_a_polynomial_collision(spark):
    x, y = thue_morse(1024)
    rows = [(0, f"{x} {x} one"), (1, f"{y} one"), (3, "two")]
    docs = spark.createDataFrame(rows, DOCS)
    got = katz.score_texts(docs, id_crc("doc_id") % 7 == 2).collect()
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, got)), key=repr) == brute_katz(rows, katz.VOCABULARY)


def test_rows_and_contexts_of_a_polynomial_collision(spark):
    x, y = thue_morse(2048)
    rows = [(1, x), (1, y), (2, "-" * 500 + x[:600]), (3, y + "." * 401)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), length=400).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, 400)


def test_word_hashes_by_size():
    words = [b"a" * n for n in range(1, 80)] + [b"a" * 7 + b"b", b"ab", b"ba", b"a\0", b"a\0\0"]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    h = word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(words)
    again = word_hashes(raw[starts[40] :], starts[40:] - starts[40], ends[40:] - starts[40])
    assert (again == h[40:]).all()
