"""LM scoring by Katz backoff: Good-Turing discounted bigram counts with exactly normalised
backoff weights, over all words of the training texts and an unknown word.

Model. P(w | v) is evaluated recursively: a bigram that training saw has its discounted share
of v's count; else the backoff weight of v times w's unigram probability. The unknown word
counts as one occurrence. Sums over all words, known or not, are 1 for every context.

Plan. Unigrams are counted over all training texts (pre-aggregated by task, then by word). The
VOCABULARY most frequent ones are broadcast and get short numbers, which only saves work: other
words go by their hashes, with the same counts and bigrams. Every document's bigrams, counted by
document, are dealt by context to partitions as sorted, compressed arrays, and the counts of the
other words that a partition meets are sent there from the table of unigrams. Each partition
counts its bigrams, a part at a time, and writes one table row with the counts and the documents
where they occur. A second scan of that partitioned table scores every occurrence and sends one
partial sum a document and partition.

Frequent contexts are spread by successor, and bigrams that hold more than 1/HEAVY of a sample of
the text pieces by document, too (the sample decides where rows go, never what they count). What
their weights need is summed over the partitions in Spark: a row a frequent context (numbered
words only, so VOCABULARY + 2 at most) and a row a heavy bigram (HEAVY at most) reach the driver.

Defined results: null text counts as empty; an empty text is the end mark alone. Words are
split at blanks and \\t \\n \\v \\f \\r with A-Z lower-cased; words are told apart by 64-bit hashes.
Rows repeated in full get a row each. Without training texts all words are unknown. An empty
table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, digests, flat, lowered, materialise, mix64, small_batches, word_bounds, word_hashes

#: Words that are broadcast (16 bytes each); results do not depend on it.
VOCABULARY = 1 << 18
#: Good-Turing discounts apply to counts up to this.
CUTOFF = 5
#: Occurrences of a partition of the n-gram table, and the parts of a partition that are sorted one by one.
PARTITION = 4_000_000
SUBS = 8
LEAST_PARTITIONS = 16
#: Tokens that a task packs at a time, and bytes that it hashes at a time.
BLOCK = 1_000_000
CHUNK = 1 << 18
#: One in SAMPLED pieces of text shows which bigrams hold more than 1 / HEAVY of all.
SAMPLED = 64
HEAVY = 1 << 10

#: Numbers below this are frequent words, the end and the start; from it on, hashes.
NUMBERS = 1 << 20
BIGRAMS, WORDS, DOCS = 0, 1, 2
#: Kinds of rows of the first count; the end and the start in its pairs.
WORD, PAIR, SIZE = 0, 1, 2
END, START = 0, 1


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = word_hashes(raw, starts, ends)
    return np.where(h < NUMBERS, h + np.uint64(NUMBERS), h)


def bigrams(tokens: np.ndarray, n_words: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and tokens of documents of n_words words each, an end mark after each document."""
    n_docs = len(n_words)
    owner = np.repeat(np.arange(n_docs), n_words)
    # tokens of document d stand at first[d] .. first[d] + n_words[d], the end mark last
    first = np.cumsum(n_words + 1) - (n_words + 1)
    tok = np.full(len(tokens) + n_docs, end, np.uint64)
    tok[np.arange(len(tokens)) + owner] = tokens
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[first] = start
    return ctx, tok


def _counted(sampled: int, heavy: int):
    """(kind, ctx, word, n): the words of a task; of some pieces of text their frequent pairs, and their sizes."""
    out = pa.schema([("kind", pa.int32()), ("ctx", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held, rows = [], 0

        def summed():
            w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(w)
            w, n = w[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
            return w[start], np.add.reduceat(n, start) if len(w) else n

        def batch_of(kind, ctx, w, n):
            for i in range(0, len(w), 1 << 17):
                part = slice(i, i + (1 << 17))
                cols = [np.full(len(w[part]), kind, np.int32), ctx[part].view(np.int64), w[part].view(np.int64), n[part]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=out)

        def pairs(h, n_words):
            ctx, tok = bigrams(h, n_words, START, END)
            order = np.lexsort((tok, ctx))
            ctx, tok = ctx[order], tok[order]
            start = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (tok[1:] != tok[:-1])]))
            n = np.diff(np.append(start, len(ctx)))
            many = n * 2 * heavy > len(ctx)
            yield from batch_of(PAIR, ctx[start][many], tok[start][many], n[many])
            yield from batch_of(SIZE, np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([len(ctx)], np.int64))

        for batch in batches:
            raw_all, off_all = flat(batch.column("text"))
            for i, j in chunks(off_all, CHUNK):
                raw = lowered(raw_all[off_all[i] : off_all[j]])
                s, e, owner = word_bounds(raw, off_all[i : j + 1] - off_all[i])
                h = hash_words(raw, s, e)
                if xxhash.xxh3_64_intdigest(raw) % sampled == 0:
                    yield from pairs(h, np.bincount(owner, minlength=j - i))
                if len(s):
                    w, n = np.unique(h, return_counts=True)
                    held.append((w, n))
                    rows += len(w)
            if rows > 1_000_000:
                held = [summed()]
                rows = len(held[0][0])
                if rows > 500_000:
                    yield from batch_of(WORD, np.zeros(rows, np.uint64), *held[0])
                    held, rows = [], 0
        if held:
            w, n = summed()
            yield from batch_of(WORD, np.zeros(len(w), np.uint64), w, n)

    return count


class Vocabulary:
    """Sorted hashes of the frequent words, counts by number (words, end, start) and totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, kinds: int, docs: int):
        order = np.argsort(words)
        self.words = words[order]
        k = len(words)
        self.end, self.start = k, k + 1
        self.n, self.v = total + docs, kinds + (docs > 0)
        self.kinds = kinds + 2  # with the end and the unknown word
        self.counts = np.concatenate([counts[order], [docs, docs]]).astype(np.int64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Of hashes: the numbers of frequent words, other words as they are."""
        if not len(self.words) or not len(h):
            return h
        kinds, of = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, kinds), len(self.words) - 1)
        return np.where(self.words[at] == kinds, at.astype(np.uint64), kinds)[of]

    def counts_of(self, tok: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Training counts of tokens; ``others`` holds those of the tokens that have no number."""
        short = tok < NUMBERS
        out = np.empty(len(tok), np.int64)
        out[short], out[~short] = self.counts[tok[short].astype(np.int64)], others
        return out

    def unigram(self, tok: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unigram probabilities; an unknown word has the place of one occurrence."""
        return np.where((tok >= NUMBERS) & (counts == 0), 1, counts) / (self.n + 1.0)


class Plan:
    """Where bigrams go. hot: which numbers are frequent contexts; heavy: sorted (context, token) pairs of numbers."""

    def __init__(self, v: Vocabulary, parts: int, hot: np.ndarray, pairs: np.ndarray):
        self.parts = parts
        both = self._keys(pairs[:, 0], pairs[:, 1])
        self.heavy = np.unique(both)
        self.hot = hot.copy()
        self.hot[(self.heavy >> np.uint64(32)).astype(np.int64)] = True
        self.before_heavy = np.zeros(len(hot), bool)
        self.before_heavy[(self.heavy >> np.uint64(32)).astype(np.int64)] = True

    @staticmethod
    def _keys(ctx: np.ndarray, tok: np.ndarray) -> np.ndarray:
        return ctx.astype(np.uint64) << np.uint64(32) | tok.astype(np.uint64)

    def _of(self, ctx: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return marks[np.minimum(ctx, np.uint64(len(marks) - 1)).astype(np.int64)] & (ctx < len(marks))

    def is_hot(self, ctx: np.ndarray) -> np.ndarray:
        return self._of(ctx, self.hot)

    def heavy_number(self, ctx: np.ndarray, tok: np.ndarray) -> np.ndarray:
        """The number of each pair among the heavy ones, or -1."""
        out = np.full(len(ctx), -1, np.int64)
        if len(self.heavy):
            some = np.flatnonzero(self._of(ctx, self.before_heavy) & (tok < NUMBERS))
            key = self._keys(ctx[some], tok[some])
            at = np.minimum(np.searchsorted(self.heavy, key), len(self.heavy) - 1)
            out[some] = np.where(self.heavy[at] == key, at, -1)
        return out

    def places(self, ctx: np.ndarray, tok: np.ndarray, row: np.ndarray | None) -> np.ndarray:
        """Partition * SUBS + part: by context; of a hot context by successor, too; of a heavy pair by document, too."""
        by = mix64(ctx + np.uint64(77))
        hot = np.flatnonzero(self.is_hot(ctx))
        by[hot] = mix64(by[hot] + tok[hot])
        if row is not None and len(hot) and len(self.heavy):
            hot = hot[self.heavy_number(ctx[hot], tok[hot]) >= 0]
            by[hot] = mix64(by[hot] ^ row[hot])
        return (by % np.uint64(self.parts)).astype(np.int64) * SUBS + ((by >> np.uint64(40)) % np.uint64(SUBS)).astype(np.int64)


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return bytes(pa.compress(planes, codec="zstd", asbytes=True)) if planes else b""


def unpack(data: bytes, dtype, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64, n), dtype=np.uint64)


_PIECES = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("n", pa.list_(pa.int32())), ("n_docs", pa.int32()), ("keys", pa.binary()), ("toks", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()), ("rows", pa.binary()), ("more", pa.binary())])
_PIECES_SQL = "pid int, kind int, n array<int>, n_docs int, keys binary, toks binary, docs binary, times binary, rows binary, more binary"


def record(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    """Rows of a schema; a binary column that a row does not name is empty, a number 0, a list empty."""

    def none(kind):
        return b"" if pa.types.is_binary(kind) else [] if pa.types.is_list(kind) else 0

    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name, none(f.type)) for r in rows], f.type) for f in schema], schema=schema)


def _wanted(vocab, plan):
    """Which words without a number a partition meets as successors, distinct in a task's pieces."""
    out = pa.schema([("pid", pa.int32()), ("word", pa.int64())])

    def wanted(batches):
        v: Vocabulary = vocab.value
        deal: Plan = plan.value
        held, size = [], 0

        def distinct():
            pid, tok = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((tok, pid))
            pid, tok = pid[order], tok[order]
            new = np.ones(len(tok), bool)
            new[1:] = (pid[1:] != pid[:-1]) | (tok[1:] != tok[:-1])
            return pid[new], tok[new]

        def batch_of(pid, tok):
            for i in range(0, len(tok), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(pid[i : i + (1 << 17)]), pa.array(tok[i : i + (1 << 17)].view(np.int64))], schema=out)

        for batch in batches:
            raw_all, off_all = flat(batch.column("text"))
            for i, j in chunks(off_all, CHUNK):
                raw, off = lowered(raw_all[off_all[i] : off_all[j]]), off_all[i : j + 1] - off_all[i]
                s, e, owner = word_bounds(raw, off)
                ctx, tok = bigrams(v.numbers(hash_words(raw, s, e)), np.bincount(owner, minlength=j - i), v.start, v.end)
                other = tok >= NUMBERS
                held.append(((deal.places(ctx[other], tok[other], None) // SUBS).astype(np.int32), tok[other]))
                size += int(other.sum())
                if size >= BLOCK:
                    held = [distinct()]
                    size = len(held[0][0])
                    if size > BLOCK // 2:
                        yield from batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield from batch_of(*distinct())

    return wanted


def _sent(batches):
    """(pid, word, n) of a task as one piece a partition."""
    cols = [[np.asarray(b.column(c)) for c in ("pid", "word", "n")] for b in batches]
    if not cols:
        return
    pid, word, n = map(np.concatenate, zip(*cols, strict=True))
    word = word.view(np.uint64)
    order = np.lexsort((word, pid))
    pid, word, n = pid[order], word[order], n[order]
    pids, cut = np.unique(pid, return_index=True)
    for p, i, j in zip(pids.tolist(), cut, [*cut[1:], len(pid)], strict=True):
        yield record(_PIECES, [{"pid": p, "kind": WORDS, "n": [j - i], "toks": pack(word[i:j]), "docs": pack(n[i:j])}])


def _dealt(vocab, plan):
    def deal(batches):
        v: Vocabulary = vocab.value
        to: Plan = plan.value
        log_c = np.log10(v.counts + 1.0)

        def block(h, n_words, text_hash, ids, valid, held):
            n_docs = len(n_words)
            ctx, tok = bigrams(v.numbers(h), n_words, v.start, v.end)
            doc = np.repeat(np.arange(n_docs, dtype=np.int32), n_words + 1)
            rows = np.array([int.from_bytes(hashlib.blake2b(b"%d|" % i if ok else b"|", digest_size=8).digest(), "little") for i, ok in zip(ids.tolist(), valid.tolist(), strict=True)], np.uint64)
            rows = mix64(rows ^ text_hash)
            common = tok < NUMBERS
            short = tok[common].astype(np.int64)
            base = np.bincount(doc[common], log_c[short], n_docs)
            known = np.bincount(doc[common], (v.counts[short] > 0).astype(float), n_docs).astype(np.int64)
            yield from pieces(to.places(ctx, tok, rows[doc]), ctx, tok, doc, rows, (~held).astype(np.uint8))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~valid), pa.array(held), pa.array(n_words + 1), pa.array(known), pa.array(base)], names=["doc_id", "held_out", "n_tokens", "n_known", "base"]
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            data = bytes(pa.compress(sink.getvalue(), codec="zstd", asbytes=True))
            yield record(_PIECES, [{"pid": int(rows[0] % np.uint64(to.parts)), "kind": DOCS, "n": [len(sink.getvalue())], "n_docs": n_docs, "rows": pack(rows), "more": data}])

        def pieces(place, ctx, tok, doc, rows, trained):
            order = np.lexsort((tok, ctx, place))  # documents ascend among equals
            place, ctx, tok, doc = place[order], ctx[order], tok[order], doc[order]
            new = np.ones(len(tok), bool)
            new[1:] = (ctx[1:] != ctx[:-1]) | (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(tok))).astype(np.uint32)
            place, ctx, tok, doc = place[start], ctx[start], tok[start], doc[start]
            pids, cut = np.unique(place // SUBS, return_index=True)
            out = []
            for p, i, j in zip(pids.tolist(), cut, [*cut[1:], len(place)], strict=True):
                used, local = np.unique(doc[i:j], return_inverse=True)
                n = np.bincount(place[i:j] - p * SUBS, minlength=SUBS).tolist()
                out.append({"pid": p, "kind": BIGRAMS, "n": n, "n_docs": len(used), "keys": pack_sorted(ctx[i:j]), "toks": pack(tok[i:j]), "docs": pack(local.astype(np.uint16 if len(used) < 65536 else np.uint32)), "times": pack(times[i:j]), "rows": pack(rows[used]), "more": pack(trained[used])})
            for i in range(0, len(out), 16):
                yield record(_PIECES, out[i : i + 16])

        held, size = [], 0
        for batch in batches:
            raw_all, off_all = flat(batch.column("text"))
            col = batch.column("doc_id")
            valid = np.asarray(col.is_valid())
            ids = np.asarray(col.fill_null(0), np.int64)
            out = np.asarray(batch.column("held_out"))
            for i, j in chunks(off_all, CHUNK):
                raw, off = lowered(raw_all[off_all[i] : off_all[j]]), off_all[i : j + 1] - off_all[i]
                s, e, owner = word_bounds(raw, off)
                held.append((hash_words(raw, s, e), np.bincount(owner, minlength=j - i), digests(raw, off[:-1], off[1:])[:, 0], ids[i:j], valid[i:j], out[i:j]))
                size += len(s) + j - i
                if size >= BLOCK:
                    yield from block(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from block(*map(np.concatenate, zip(*held, strict=True)))

    return deal


_LISTS = ("keys", "toks", "others", "counts", "reps", "docs", "times")
_TABLE = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("n_docs", pa.int64()), ("n", pa.list_(pa.int64())), ("n_keys", pa.list_(pa.int64())), *[(c, pa.list_(pa.binary())) for c in _LISTS], ("rows", pa.binary()), ("body", pa.binary()), ("n_r", pa.list_(pa.int64())), ("hot", pa.list_(pa.float64())), ("pairs", pa.list_(pa.float64()))])
_TABLE_SQL = "pid int, kind int, n_docs long, n array<bigint>, n_keys array<bigint>, " + ", ".join(f"{c} array<binary>" for c in _LISTS) + ", rows binary, body binary, n_r array<bigint>, hot array<double>, pairs array<double>"


def context_sums(ctx: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context of seen bigrams (sorted by context): bigrams with count 1..CUTOFF, words in larger counts,
    unigram probability of the successors (p, by bigram), number of successors."""
    start = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
    if not len(start):
        return ctx[:0], np.zeros((0, CUTOFF + 3))
    cols = [np.add.reduceat((c == r).astype(np.float64), start) for r in range(1, CUTOFF + 1)]
    cols += [np.add.reduceat(np.where(c > CUTOFF, c, 0).astype(np.float64), start), np.add.reduceat(p, start), np.add.reduceat(np.ones(len(c)), start)]
    return ctx[start], np.stack(cols, 1)


def _looked_up(sent: tuple | None, words: np.ndarray) -> np.ndarray:
    """Training counts of words by the sorted words sent to a partition and their counts; 0 for those that training never saw."""
    if sent is None or not len(words):
        return np.zeros(len(words), np.int64)
    word, n = sent
    at = np.minimum(np.searchsorted(word, words), len(word) - 1)
    return np.where(word[at] == words, n[at], 0)


def _merged(vocab, plan):
    def merge(batches):
        v: Vocabulary = vocab.value
        to: Plan = plan.value
        by: dict[int, dict[int, list[dict]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == DOCS:
                    yield record(_TABLE, [{"pid": r["pid"], "kind": DOCS, "n_docs": r["n_docs"], "n": r["n"], "rows": r["rows"], "body": r["more"]}])
                else:
                    by.setdefault(r["pid"], {BIGRAMS: [], WORDS: []})[r["kind"]].append(r)
        for pid in sorted(by):  # one, as rows are dealt by partition number
            yield one(v, to, pid, by.pop(pid))
            pa.default_memory_pool().release_unused()

    def one(v, to, pid, found):
        words = None
        if found[WORDS]:
            w = np.concatenate([unpack(r["toks"], np.uint64, r["n"][0]) for r in found[WORDS]])
            n = np.concatenate([unpack(r["docs"], np.int64, r["n"][0]) for r in found[WORDS]])
            order = np.argsort(w)
            words = w[order], n[order]
        pieces, rows, trained, n_docs = [], [], [], 0
        for r in found.pop(BIGRAMS):
            total = sum(r["n"])
            docs = unpack(r["docs"], np.uint16 if r["n_docs"] < 65536 else np.uint32, total).astype(np.int32) + np.int32(n_docs)
            pieces.append((np.cumsum([0, *r["n"]]), unpack_sorted(r["keys"], total), unpack(r["toks"], np.uint64, total), docs, unpack(r["times"], np.uint32, total)))
            rows.append(unpack(r["rows"], np.uint64, r["n_docs"]))
            trained.append(unpack(r["more"], np.uint8, r["n_docs"]))
            n_docs += r["n_docs"]
            r.clear()
        out = {"pid": pid, "kind": BIGRAMS, "n_docs": n_docs, "n": [], "n_keys": [], **{c: [] for c in _LISTS}}
        trained = np.concatenate(trained) if trained else np.zeros(0, np.uint8)
        n_r, hot, pairs = np.zeros(CUTOFF + 1, np.int64), [], []
        for k in range(SUBS):
            keys, toks, docs, times = (np.concatenate([x[y][x[0][k] : x[0][k + 1]] for x in pieces] or [np.zeros(0, t)]) for y, t in ((1, np.uint64), (2, np.uint64), (3, np.int32), (4, np.uint32)))
            order = np.lexsort((toks, keys))
            keys, toks, docs, times = keys[order], toks[order], docs[order], times[order]
            start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (toks[1:] != toks[:-1])])) if len(keys) else np.zeros(0, np.int64)
            c = np.add.reduceat(trained[docs] * times, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
            ctx, tok = keys[start], toks[start]
            others = _looked_up(words, tok[tok >= NUMBERS])
            number = to.heavy_number(ctx, tok)
            own = number < 0  # heavy pairs lie in several partitions and are summed over them
            n_r += np.bincount(np.minimum(c[own], CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
            of_hot = to.is_hot(ctx) & (c > 0) & own
            at, got = context_sums(ctx[of_hot], c[of_hot], v.unigram(tok, v.counts_of(tok, others))[of_hot])
            hot += np.column_stack([at, got]).ravel().tolist()
            pairs += np.column_stack([number[~own], c[~own]]).astype(float).ravel().tolist()
            out["n"].append(len(docs))
            out["n_keys"].append(len(ctx))
            for name, x in zip(_LISTS, (None, tok, others, c.astype(np.uint32), np.diff(np.append(start, len(keys))).astype(np.uint32), docs, times), strict=True):
                out[name].append(pack_sorted(ctx) if x is None else pack(x))
        return record(_TABLE, [{**out, "rows": pack(np.concatenate(rows) if rows else np.zeros(0, np.uint64)), "n_r": n_r.tolist(), "hot": hot, "pairs": pairs}])

    return merge


def discounts(n_r) -> np.ndarray:
    """Good-Turing discounts of counts 0..CUTOFF + 1 (Katz's form); where the counts of counts do not allow
    them, half a count is taken off instead."""
    d = np.ones(CUTOFF + 2)
    n = np.array([0, *n_r], float)
    absolute = 1 - 0.5 / np.maximum(np.arange(CUTOFF + 2), 1)
    absolute[CUTOFF + 1] = 1
    a = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    if not 0 <= a < 1 or (n[1 : CUTOFF + 1] == 0).any():
        return absolute
    for r in range(1, CUTOFF + 1):
        d[r] = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
    return d if ((d[1 : CUTOFF + 1] > 0) & (d[1 : CUTOFF + 1] < 1)).all() else absolute


def weights(sums: np.ndarray, total: np.ndarray, d: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and backoff weight of each context; seen shares plus weight times the unseen sum to 1."""
    r = np.arange(1, CUTOFF + 1)
    seen = (sums[:, :CUTOFF] * (d[1 : CUTOFF + 1] * r)).sum(1) + sums[:, CUTOFF]
    unseen = np.maximum(1 - sums[:, CUTOFF + 1], 0)
    full = sums[:, CUTOFF + 2] >= classes  # every class was seen: nothing to back off to
    denominator = np.where(full, seen, np.where(seen >= total - 1e-9, total + 1, total))
    alpha = np.where(full, 0.0, (1 - seen / denominator) / np.where(full | (unseen <= 0), 1.0, unseen))
    return denominator, alpha


def bigram_logs(ctx: np.ndarray, c: np.ndarray, p: np.ndarray, v: Vocabulary, d: np.ndarray, is_hot: np.ndarray, hot: tuple) -> np.ndarray:
    """log10 P(token | context) of distinct bigrams, sorted by context, with training counts c and unigrams p.
    ``hot``: sorted frequent contexts, their denominators and backoff weights."""
    if not len(ctx):
        return np.zeros(0)
    seen = c > 0
    new = np.concatenate([[True], ctx[1:] != ctx[:-1]])
    contexts, group = ctx[new], np.cumsum(new) - 1
    at, sums = context_sums(ctx[seen], c[seen], p[seen])
    total = np.bincount(group, c, len(contexts))
    den = np.ones(len(contexts))
    alpha = np.ones(len(contexts))  # a context that training never saw: the unigram itself
    place = np.searchsorted(contexts, at)
    den[place], alpha[place] = weights(sums, total[place], d, v.kinds)
    far = np.flatnonzero(is_hot[new])
    if len(far):
        den[far] = alpha[far] = 1.0
        if len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], contexts[far]), len(hot[0]) - 1)
            there = hot[0][at] == contexts[far]
            den[far[there]], alpha[far[there]] = hot[1][at[there]], hot[2][at[there]]
    share = d[np.minimum(c, CUTOFF + 1)] * c / den[group]
    with np.errstate(divide="ignore"):
        return np.log10(np.where(seen, share, alpha[group] * p))


def _scored(vocab, plan, d: np.ndarray, hot):
    out = pa.schema([("row_key", pa.int64()), ("score", pa.float64()), ("base", pa.float64()), ("known", pa.int32())])

    def score(batches):
        v: Vocabulary = vocab.value
        to: Plan = plan.value
        contexts, den, alpha, heavy = hot.value
        for batch in batches:
            for k in range(batch.num_rows):  # a row is large: one at a time
                r = batch.slice(k, 1).to_pylist()[0]
                rows = unpack(r["rows"], np.uint64, r["n_docs"])
                total, base, known = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
                for n, n_keys, *packed in zip(r["n"], r["n_keys"], *[r[c] for c in _LISTS], strict=True):
                    if not n:
                        continue
                    keys, tok = unpack_sorted(packed[0], n_keys), unpack(packed[1], np.uint64, n_keys)
                    c = unpack(packed[3], np.uint32, n_keys).astype(np.int64)
                    number = to.heavy_number(keys, tok)
                    c[number >= 0] = heavy[number[number >= 0]]
                    far = tok >= NUMBERS
                    counts = v.counts_of(tok, unpack(packed[2], np.int64, int(far.sum())))
                    logs = bigram_logs(keys, c, v.unigram(tok, counts), v, d, to.is_hot(keys), (contexts, den, alpha))
                    reps, docs, times = unpack(packed[4], np.uint32, n_keys), unpack(packed[5], np.int32, n), unpack(packed[6], np.uint32, n).astype(float)
                    total += np.bincount(docs, np.repeat(logs, reps) * times, len(rows))
                    other = np.repeat(far, reps)
                    docs, times = docs[other], times[other]
                    base += np.bincount(docs, np.repeat(np.log10(counts[far] + 1.0), reps[far]) * times, len(rows))
                    known += np.bincount(docs, np.repeat(counts[far] > 0, reps[far]) * times, len(rows))
                del r
                pa.default_memory_pool().release_unused()
                # blocks that share a partition may each name a row
                cols = [rows.view(np.int64), total, base, known.astype(np.int32)]
                for i in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in cols], schema=out)

    return score


def _documents(batches):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "base")
    for batch in batches:
        for r in batch.to_pylist():
            with pa.ipc.open_stream(pa.decompress(r["body"], r["n"][0], codec="zstd")) as s:
                for got in s:
                    yield pa.RecordBatch.from_arrays([pa.array(unpack(r["rows"], np.uint64, r["n_docs"]).view(np.int64)), *[got.column(c) for c in names]], names=["row_key", *names])


def _vocabulary(unigrams: DataFrame, size: int, n_train: int) -> Vocabulary:
    """The ``size`` most frequent words (ties to the least hash) are the only ones that reach the driver."""
    total, kinds = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The count that the last word of the vocabulary has, from the table of distinct counts: tasks then send few words.
    least, left = 1, size
    for r in unigrams.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.col("n").desc()).toLocalIterator():
        least, left = r["n"], left - r["k"]
        if left <= 0:
            break
    sure = unigrams.where(F.col("n") > least).toPandas()
    ties = unigrams.where(F.col("n") == least).orderBy("word").limit(size - len(sure)).toPandas()
    words, counts = (np.concatenate([sure[c].to_numpy(np.int64), ties[c].to_numpy(np.int64)]) for c in ("word", "n"))
    return Vocabulary(words.view(np.uint64), counts, total, kinds, n_train)


def _plan(v: Vocabulary, counted: DataFrame, parts: int, heavy: int) -> Plan:
    sampled = counted.where(F.col("kind") == SIZE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = counted.where((F.col("kind") == PAIR) & (F.col("n") * heavy > sampled)).select("ctx", "word").collect()  # under ``heavy`` rows
    found = np.array([tuple(r) for r in pairs], np.int64).reshape(-1, 2).view(np.uint64)
    numbers = np.stack([np.where(x == START, np.uint64(v.start), np.where(x == END, np.uint64(v.end), v.numbers(x))) for x in found.T], 1) if len(found) else found
    return Plan(v, parts, v.counts * (8 * parts) > v.n, numbers[(numbers < NUMBERS).all(1)])


def _hot_weights(v: Vocabulary, plan: Plan, table: DataFrame) -> tuple[np.ndarray, tuple]:
    """Discounts; and of frequent contexts the denominators and backoff weights, with the counts of heavy pairs."""
    width = CUTOFF + 4
    rows = table.where(F.col("kind") == BIGRAMS)
    n_r = rows.agg(*[F.coalesce(F.sum(F.col("n_r")[i]), F.lit(0)) for i in range(CUTOFF + 1)]).first()

    def cut(column: str, n: int) -> DataFrame:
        each = F.explode(F.expr(f"transform(sequence(0, cast(size({column}) / {n} as int) - 1), i -> slice({column}, i * {n} + 1, {n}))"))
        return rows.where(F.size(column) > 0).select(each.alias("x"))

    pairs = cut("pairs", 2).groupBy(F.col("x")[0].cast("int").alias("k")).agg(F.sum(F.col("x")[1]).cast("long").alias("c")).collect()
    heavy = np.zeros(len(plan.heavy), np.int64)
    for r in pairs:
        heavy[r["k"]] = r["c"]
    got = cut("hot", width).groupBy(F.col("x")[0].alias("k")).agg(*[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(1, width)]).collect()
    contexts = np.flatnonzero(plan.hot)
    sums = np.zeros((len(contexts), width - 1))
    for r in got:
        sums[np.searchsorted(contexts, int(r["k"]))] = r[1:]
    ctx, tok = (plan.heavy >> np.uint64(32)).astype(np.int64), (plan.heavy & np.uint64(0xFFFFFFFF))
    seen = heavy > 0
    at, more = context_sums(ctx[seen], heavy[seen], v.unigram(tok, v.counts[tok.astype(np.int64)])[seen])
    sums[np.searchsorted(contexts, at)] += more
    d = discounts(np.array(n_r) + np.bincount(np.minimum(heavy, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2])
    there = sums[:, -1] > 0
    den, alpha = weights(sums[there], v.counts[contexts[there]].astype(float), d, v.kinds)
    return d, (contexts[there].astype(np.uint64), den, alpha, heavy)


def score_texts(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, sampled: int = SAMPLED, heavy: int = HEAVY) -> DataFrame:
    """Train on the rows where ``held_out`` (a condition on the id) does not hold; score all.

    One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = slim.where(~F.col("held_out"))
    with small_batches(spark):
        counted = train.select("text").mapInArrow(_counted(sampled, heavy), "kind int, ctx long, word long, n long").groupBy("kind", "ctx", "word").agg(F.sum("n").alias("n"))
        counted = materialise(counted, "katz-unigrams")
    unigrams = counted.where(F.col("kind") == WORD).select("word", "n")
    n_train, n_all = slim.agg(F.count(F.when(~F.col("held_out"), 1)), F.count("*")).first()
    v = _vocabulary(unigrams, min(vocabulary, NUMBERS - 2), n_train)
    tokens = v.n * max(1, n_all) // max(1, n_train) + n_all
    parts = max(LEAST_PARTITIONS, -(-tokens // PARTITION))
    to = _plan(v, counted, parts, heavy)
    shared, plan = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(to)
    dealt = slim.mapInArrow(_dealt(shared, plan), _PIECES_SQL)
    if v.kinds - 2 > len(v.words):
        wanted = slim.select("text").mapInArrow(_wanted(shared, plan), "pid int, word long").distinct()
        dealt = dealt.unionAll(wanted.join(unigrams.hint("merge"), "word").select("pid", "word", "n").mapInArrow(_sent, _PIECES_SQL))
    with small_batches(spark, 64):
        table = materialise(dealt.repartitionById(parts, "pid").mapInArrow(_merged(shared, plan), _TABLE_SQL), "katz-ngrams")
    d, hot = _hot_weights(v, to, table)
    sides = ["n_docs", "n", "n_keys", *_LISTS, "rows"]
    part = table.where(F.col("kind") == BIGRAMS).select(*sides).mapInArrow(_scored(shared, plan, d, spark.sparkContext.broadcast(hot)), "row_key long, score double, base double, known int")
    part = part.groupBy("row_key").agg(F.sum("score").alias("score"), F.sum("base").alias("base"), F.sum("known").alias("known"))
    meta = table.where(F.col("kind") == DOCS).select("n", "n_docs", "rows", "body").mapInArrow(_documents, "row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double")
    # Rows repeated in full share a key and summed alike: each gets its share.
    meta = meta.groupBy("row_key").agg(F.count("*").alias("m"), F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"), F.max("base").alias("meta_base"))
    both = meta.join(part, "row_key", "left").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    out = both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("known") / F.col("m"), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(int(v.n)).cast("long").alias("train_tokens"),
        (F.col("meta_base") + F.coalesce(F.col("base") / F.col("m"), F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(v.n + v.v + 1)))).alias("base_score"),
        (F.coalesce(F.col("score"), F.lit(0.0)) / F.col("m")).alias("score"),
    )
    with small_batches(spark, 1):  # a row of the table holds a partition
        return materialise(out, "katz-scores")
