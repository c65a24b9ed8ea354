"""SentencePiece encoding and decoding with a given model file, by batched numpy Viterbi.

Texts are cut before each run of blanks (no piece of a model holds a blank after another
character; a model with such a piece is refused), distinct words of a batch are grouped by
length, and words of equal length advance together: for each end position and piece length
one vectorised probe of the sorted hashes of the pieces of that length, and one vectorised
maximum that stores back-pointers. Ties go to the longer last piece. Characters without a
piece cost the least score less UNKNOWN and become byte pieces.

The segmentation is the best-scoring one under the scores in the file (the unigram rule).
The supplied model file is of kind BPE, whose own encoder merges greedily; ids may differ
from that encoder's, the decoded text does not. See the README.

Defined results: null and empty texts encode to no pieces, and decode to the empty text.
The blank mark U+2581 in a text is written as byte pieces, so every text decodes to itself.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from millrace.llm.common import chunks, flat, mix64

BLANK = "▁"
UNKNOWN = 10.0
#: Bytes of text that are encoded, and ids that are decoded, at a time.
CHUNK = 2 << 20
BLOCK = 1 << 18
#: Distinct words that a Python worker remembers between batches.
REMEMBERED = 250_000
#: Words of more characters than this are taken one by one, in blocks of so many characters.
LONG = 512
#: Bits of a hash by which most substrings are told not to be pieces before the sorted keys are searched.
SIEVE = 17
#: Longest words that advance together in one matrix; longer ones are taken in blocks of the same bytes.
MATRIX = 1 << 22
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_B = 0x9E3779B97F4A7C15 | 1
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def _fields(data: bytes):
    """(number, value) of the fields of a protobuf message: ints and byte strings."""
    i = 0

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class Vocabulary:
    """Pieces, scores and kinds of a model file, with hashed tables by piece length."""

    NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        settings = {}
        for number, value in _fields(model):
            if number in (2, 3):
                settings[number] = dict(_fields(value))
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                self.kinds.append(f.get(3, 1))
        self._check(settings)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        usable = [i for i, k in enumerate(self.kinds) if k in (self.NORMAL, self.USER) and self.pieces[i]]
        if any(re.search(f"[^{BLANK}]{BLANK}", self.pieces[i]) for i in usable):
            raise ValueError("a piece holds a blank after another character")
        self.unknown = min(self.scores[i] for i in usable) - UNKNOWN
        self.by_text = {self.pieces[i]: (self.scores[i], i) for i in usable}
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.sieves: dict[int, np.ndarray] = {}
        for n in range(1, self.longest + 1):
            ids = np.array([i for i in usable if len(self.pieces[i]) == n], np.int64)
            if not len(ids):
                continue
            cps = np.frombuffer("".join(self.pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(len(ids), n)
            key = _hashes(cps.T)[n]
            order = np.argsort(key)
            self.tables[n] = key[order], np.array(self.scores)[ids[order]], ids[order]
            self.sieves[n] = np.zeros(1 << SIEVE, bool)
            self.sieves[n][key >> np.uint64(64 - SIEVE)] = True
        self.as_bytes = [bytes([int(p[3:5], 16)]) if k == self.BYTE else b"" if k in (self.UNK, self.CONTROL) else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.flat = np.frombuffer(b"".join(self.as_bytes), np.uint8)
        self.sizes = np.array([len(x) for x in self.as_bytes], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _check(settings: dict[int, dict]) -> None:
        """Only texts as they are, with blanks as marks and one mark in front, are encoded here: other settings are refused."""
        trainer, normalizer = settings.get(2, {}), settings.get(3, {})
        odd = {
            "a table of character replacements": normalizer.get(2, b""),
            "no mark in front": not normalizer.get(3, 1),
            "removal of blanks": normalizer.get(4, 1),
            "blanks that are not marked": not normalizer.get(5, 1),
            "marks after words": trainer.get(24, 0),
            "no byte pieces for unknown characters": not trainer.get(35, 0),
            "a kind other than unigram or BPE": trainer.get(3, 1) not in (1, 2),
        }
        if found := [k for k, v in odd.items() if v]:
            raise ValueError(f"the model asks for {', '.join(found)}")

    def probe(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the hashes of substrings of n characters: which are pieces, and their rows in the sorted table."""
        table = self.tables[n][0]
        some = np.flatnonzero(self.sieves[n][keys >> np.uint64(64 - SIEVE)])
        at = np.minimum(np.searchsorted(table, keys[some]), len(table) - 1)
        there = table[at] == keys[some]
        return some[there], at[there]


_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) <= n:
        for k, b in enumerate((_B, pow(_B, -1, 2**64))):
            p = np.full(2 * n + 64, b, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def _hashes(cps: np.ndarray) -> np.ndarray:
    """Prefix hashes of each column of code points; row j covers the first j. Only ranges as long as a piece are compared."""
    up, _ = _powers(cps.shape[0] + 1)
    h = np.zeros((cps.shape[0] + 1, cps.shape[1]), np.uint64)
    np.cumsum(mix64(cps.astype(np.uint64) + np.uint64(0x51ED270B)) * up[: cps.shape[0], None], axis=0, out=h[1:])
    return h


def found_pieces(cps: np.ndarray, v: Vocabulary) -> list[list[tuple]]:
    """For words of equal length n, as columns of code points: for each end position, the pieces that end there, as
    (length, columns, scores, ids) by ascending length."""
    n, m = cps.shape
    h = _hashes(cps)
    _, down = _powers(n + 1)
    out: list[list[tuple]] = [[] for _ in range(n + 1)]
    for length in range(1, min(n, v.longest) + 1):
        if length not in v.tables:
            continue
        _, scores, pieces = v.tables[length]
        some, at = v.probe(length, ((h[length:] - h[:-length]) * down[: n - length + 1, None]).ravel())
        cut = np.searchsorted(some, np.arange(n - length + 2) * m)
        for i in np.flatnonzero(cut[1:] > cut[:-1]):
            part = slice(cut[i], cut[i + 1])
            out[i + length].append((length, some[part] - i * m, scores[at[part]], pieces[at[part]]))
    return out


def viterbi(cps: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For words of equal length, as columns of code points: back-pointers (length of the piece that ends at each
    position) and its id (-1: a character without a piece)."""
    n, m = cps.shape
    best = np.zeros((n + 1, m))
    back = np.ones((n + 1, m), np.int32)
    ids = np.full((n + 1, m), -1, np.int32)
    for j, ending in enumerate(found_pieces(cps, v)):
        if j:
            best[j] = best[j - 1] + v.unknown
        for length, at, score, piece in ending:
            total = best[j - length][at] + score
            if length > 1:
                won = total >= best[j][at]
                at, total, piece = at[won], total[won], piece[won]
            best[j][at] = total
            back[j][at] = length
            ids[j][at] = piece
    return back, ids


def segment_long(word: str, v: Vocabulary) -> list[int]:
    """The same for one long word, a block of characters at a time: ids, -1 - c for a character c without a piece."""
    cps = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cps)
    best, back, ids = [0.0] * (n + 1), bytearray(n + 1), [-1] * (n + 1)
    for lo in range(0, n, LONG):  # pieces that start before the block are found in the block before
        part = cps[lo : lo + LONG + v.longest - 1]
        h = _hashes(part[:, None])[:, 0]
        _, down = _powers(len(part) + 1)
        starts: dict[int, list[tuple]] = {}
        for length in range(1, min(len(part), v.longest) + 1):
            if length in v.tables:
                _, scores, pieces = v.tables[length]
                some, at = v.probe(length, (h[length:] - h[:-length]) * down[: len(part) - length + 1])
                inside = some < LONG
                for i, s, k in zip(some[inside].tolist(), scores[at[inside]].tolist(), pieces[at[inside]].tolist(), strict=True):
                    starts.setdefault(i, []).append((length, s, k))
        for i in range(lo, min(lo + LONG, n)):
            reach = starts.get(i - lo, ())
            base = best[i]
            if not (reach and reach[0][0] == 1) and (back[i + 1] == 0 or base + v.unknown > best[i + 1]):
                best[i + 1], back[i + 1], ids[i + 1] = base + v.unknown, 1, -1
            for length, score, k in reach:
                j = i + length
                if back[j] == 0 or base + score > best[j]:
                    best[j], back[j], ids[j] = base + score, length, k
    out, j = [], n
    while j:
        out.append(ids[j] if ids[j] >= 0 else -1 - int(cps[j - 1]))
        j -= back[j]
    return out[::-1]


def encode_words(words: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each word; equal-length words go through ``viterbi`` together."""
    return [np.frombuffer(x, np.int32) for x in encoded_words(words, v)]


def _spelt(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Byte pieces in place of the characters without a piece (-1 - c)."""
    if (ids >= 0).all():
        return ids
    return np.array([y for k in ids.tolist() for y in ([k] if k >= 0 else [v.bytes[b] for b in chr(-1 - k).encode("utf-8", "surrogatepass")])], np.int32)


def encoded_words(words: list[str], v: Vocabulary) -> list[bytes]:
    """Ids of each word as the bytes of int32."""
    out: list = [None] * len(words)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        if n > LONG:
            for i in at:
                out[i] = _spelt(np.array(segment_long(words[i], v), np.int64), v).astype(np.int32).tobytes()
            continue
        step = max(1, MATRIX // (n + 1) // 8)
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            text = "".join([words[i] for i in some])
            cps = np.ascontiguousarray(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n).T)
            back, ids = viterbi(cps, v)
            col, pos = np.arange(len(some)), np.full(len(some), n)
            cols, places, found = [], [], []
            while len(col):  # all words step back together
                piece = ids[pos, col]
                bare = piece < 0
                if bare.any():
                    piece[bare] = -1 - cps[pos[bare] - 1, col[bare]].astype(np.int32)
                cols.append(col)
                places.append(pos)
                found.append(piece)
                pos = pos - back[pos, col]
                left = pos > 0
                col, pos = col[left], pos[left]
            col, pos, piece = map(np.concatenate, (cols, places, found))
            order = np.argsort(col * (n + 1) + pos, kind="stable")
            col, piece = col[order], piece[order]
            cut = np.searchsorted(col, np.arange(len(some) + 1)).tolist()
            body = piece.astype(np.int32).tobytes()
            for x, i in enumerate(some):
                out[i] = body[4 * cut[x] : 4 * cut[x + 1]]
            for x in set(col[piece < 0].tolist()):
                out[some[x]] = _spelt(piece[cut[x] : cut[x + 1]], v).tobytes()
    return out


#: Stands for a blank mark of the text itself; a lone surrogate, which no UTF-8 text holds.
_MARK = "\ud8ff"


def split(text: str) -> list[str]:
    """Words of a text, blanks as marks before them."""
    if not text:
        return []
    if BLANK in text:
        text = text.replace(BLANK, _MARK)
    return _WORD.findall(BLANK + text.replace(" ", BLANK))


class Codec:
    """Encodes and decodes; remembers the words of late, REMEMBERED at most."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known: dict[str, bytes] = {}  # ids as int32
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the bytes of int32."""
        parts = [split(t) for t in texts]
        table, new = {}, []
        for w in set().union(*parts):
            if (ids := self.known.get(w) or self.older.get(w)) is None:
                new.append(w)
            else:
                table[w] = ids
        if new:
            ids = self._marked(new) if any(_MARK in w for w in new) else encoded_words(new, self.v)
            table.update(zip(new, ids, strict=True))
        if len(self.known) + len(table) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        if len(table) <= REMEMBERED // 2:
            self.known.update(table)
        get = table.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def _marked(self, words: list[str]) -> list[bytes]:
        """As encoded_words, but the blank marks of the text become byte pieces."""
        mark = np.array([self.v.bytes[b] for b in BLANK.encode()], np.int32).tobytes()
        parts = [w.split(_MARK) for w in words]
        got = iter(encoded_words([x for p in parts for x in p if x], self.v))
        return [mark.join([next(got) if x else b"" for x in p]) for p in parts]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The UTF-8 bytes of texts whose ids stand one after another up to ``ends``, and the end of each in the bytes.
        Each text keeps the blank of the mark in front of it."""
        out, at, done = [], 0, []
        for lo in range(0, len(ids), BLOCK):
            some = ids[lo : lo + BLOCK]
            size = self.v.sizes[some]
            upto = np.cumsum(size)
            place = np.repeat(self.v.places[some] - (upto - size), size) + np.arange(upto[-1])
            out.append(self.v.flat[place].tobytes())
            done.append(upto + at)
            at += int(upto[-1])
        upto = np.concatenate([np.zeros(1, np.int64), *done])
        return b"".join(out), upto[ends]

    def decode(self, ids: np.ndarray) -> str:
        data, _ = self.decode_all(np.asarray(ids, np.int32), np.array([len(ids)]))
        return data.decode("utf-8", "surrogatepass")[1:]


def read_model(spark: SparkSession, path: str = DEFAULT_MODEL) -> bytes:
    """The model file: from the driver's disk, or from any store that Spark reads."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def text_list(column: pa.Array):
    """Chunks of texts as lists of str; null counts as empty."""
    raw, off = flat(column)
    for i, j in chunks(off, CHUNK):
        yield [raw[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]


def _encoded(model, text_col: str, passed: list[str]):
    def encode(batches):
        codec = Codec(Vocabulary(model.value))
        for batch in batches:
            at = 0
            for texts in text_list(batch.column(text_col)):
                ids = codec.encode(texts)
                off = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                body = np.frombuffer(b"".join(ids), np.int32)
                cols = [batch.column(c).slice(at, len(texts)) for c in passed]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(off), pa.array(body)), pa.array(np.diff(off).astype(np.int64))], names=[*passed, "input_ids", "n_tokens"])

    return encode


def encode(docs: DataFrame, *, model_path: str = DEFAULT_MODEL, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, by default) with input_ids (array of int) and n_tokens.

    A column of ``docs`` that bears one of these two names is left out."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model_path))  # under 1 MB: a file of fixed size
    passed = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text_col]) if c not in ("input_ids", "n_tokens")]
    needed = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*passed, text_col])])
    schema = needed.select(*passed).schema.add("input_ids", ArrayType(IntegerType())).add("n_tokens", LongType())
    return needed.mapInArrow(_encoded(model, text_col, passed), schema)


def _decoded(model, ids_col: str, passed: list[str]):
    def decode(batches):
        codec = Codec(Vocabulary(model.value))
        for batch in batches:
            ids = batch.column(ids_col)
            texts = [codec.decode(np.asarray(x.values, np.int32)) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], pa.array(texts, pa.string())], names=[*passed, "text"])

    return decode


def decode(rows: DataFrame, *, model_path: str = DEFAULT_MODEL, ids_col: str = "input_ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``text``, the decoded ids."""
    model = rows.sparkSession.sparkContext.broadcast(read_model(rows.sparkSession, model_path))
    passed = [c for c in (keep if keep is not None else [c for c in rows.columns if c != ids_col]) if c != "text"]
    needed = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*passed, ids_col])])
    return needed.mapInArrow(_decoded(model, ids_col, passed), needed.select(*passed).schema.add("text", "string"))


def _digested(model):
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])

    def digest(batches):
        codec = Codec(Vocabulary(model.value))
        for batch in batches:
            at = 0
            for texts in text_list(batch.column("text")):
                ids = codec.encode(texts)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                data, ends = codec.decode_all(np.frombuffer(b"".join(ids), np.int32), np.cumsum(n))
                begins = [0, *ends[:-1].tolist()]
                same = [data[i + 1 : j] == t.encode("utf-8", "surrogatepass") for i, j, t in zip(begins, ends.tolist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(n), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(same)], schema=out)
                at += len(texts)

    return digest


def digests(docs: DataFrame, *, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256 (of the ids as little-endian int32), round_trip."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model_path))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_digested(model), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
