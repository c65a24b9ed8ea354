"""Token counts per document by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a batch are sorted, which lays out their trie level by level: a
new node starts wherever a prefix differs from the row above. Unigram forward scores (the
best score of a segmentation of the prefix, and the number of pieces in it) are computed
once per trie node, however many pre-tokens share that prefix; the node where a pre-token
ends stores its count. Documents sum the counts of their pre-tokens, with repeats.

Segmentation is that of ``sentencepiece_codec``: same model file, same scores, same ties.

Defined results: null and empty texts have 0 tokens. Whole texts count, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.sentencepiece_codec import _MARK, DEFAULT_MODEL, LONG, MATRIX, REMEMBERED, Vocabulary, _hashes, _powers, read_model, segment_long, split, text_list


def _utf8_length(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)


def trie_counts(words: list[str], v: Vocabulary) -> np.ndarray:
    """Number of pieces of each of the distinct ``words``."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    for i in np.flatnonzero(size > LONG):  # by the same recursion, one at a time
        ids = segment_long(words[i], v)
        out[i] = sum(1 if k >= 0 else int(_utf8_length(np.array([-1 - k]))[0]) for k in ids)
    order = sorted(np.flatnonzero(size <= LONG).tolist(), key=words.__getitem__)
    sizes = size[order].tolist()
    lo = 0
    while lo < len(order):  # blocks of bounded bytes; long words make small blocks
        hi, width = lo, 1
        while hi < len(order) and (hi - lo + 1) * (max(width, sizes[hi]) + 1) * 8 <= MATRIX or hi == lo:
            width = max(width, sizes[hi])
            hi += 1
        at = np.array(order[lo:hi])
        out[at] = _block([words[i] for i in at], size[at], width, v)
        lo = hi
    return out


def _block(words: list[str], size: np.ndarray, width: int, v: Vocabulary) -> np.ndarray:
    """The words are sorted; nodes of level j are the distinct prefixes of j characters."""
    n = len(words)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = np.zeros((n, width), np.uint32)
    cps[np.arange(width)[None, :] < size[:, None]] = flat
    h = _hashes(cps.T)
    _, down = _powers(width + 1)
    new = np.ones((n, width), bool)
    new[1:] = np.logical_or.accumulate(cps[1:] != cps[:-1], axis=1)
    counts = np.zeros(n, np.int64)
    # Per level: score and count of each node; node[j][row]: the node of the row's prefix.
    score, pieces, node = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(n, np.int64)]
    for j in range(1, width + 1):
        alive = size >= j
        fresh = new[:, j - 1] & alive
        rows = np.flatnonzero(fresh)
        node.append(np.cumsum(fresh) - 1)
        last = cps[rows, j - 1]
        up = node[j - 1][rows]
        best = score[j - 1][up] + v.unknown
        count = pieces[j - 1][up] + _utf8_length(last)
        for length in range(1, min(j, v.longest) + 1):
            if length not in v.tables:
                continue
            i = j - length
            some, at = v.probe(length, (h[j, rows] - h[i, rows]) * down[i])
            above = node[i][rows[some]]
            total = score[i][above] + v.tables[length][1][at]
            if length > 1:
                won = total >= best[some]
                some, above, total = some[won], above[won], total[won]
            best[some] = total
            count[some] = pieces[i][above] + 1
        score.append(best)
        pieces.append(count)
        ends = np.flatnonzero(size == j)
        counts[ends] = count[node[j][ends]]
    return counts


class Counter:
    """Counts tokens of texts; remembers the pre-tokens of late, REMEMBERED at most."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        parts = [split(t) for t in texts]
        table, new = {}, []
        for w in set().union(*parts):
            if (n := self.known.get(w) or self.older.get(w)) is None:
                new.append(w)
            else:
                table[w] = n
        if new:
            pieces = list({x for w in new for x in w.split(_MARK) if x})
            of = dict(zip(pieces, trie_counts(pieces, self.v).tolist(), strict=True))
            table.update((w, of[w] if _MARK not in w else 3 * w.count(_MARK) + sum(of[x] for x in w.split(_MARK) if x)) for w in new)
        if len(self.known) + len(table) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        if len(table) <= REMEMBERED // 2:
            self.known.update(table)
        get = table.__getitem__
        return [sum(map(get, p)) for p in parts]


def _counted(model):
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        counter = Counter(Vocabulary(model.value))
        for batch in batches:
            n = [x for texts in text_list(batch.column("text")) for x in counter.counts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], schema=out)

    return count


def token_counts(docs: DataFrame, *, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model_path))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_counted(model), "doc_id long, n_tokens long")
