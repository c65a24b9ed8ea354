"""Helpers shared by the operators of this subpackage.

* ``shared_dir`` / ``materialise``: intermediate tables live in the folder that the
  cluster shares (``spark.checkpoint.dir``), so a lost executor costs a re-read, not data.
* ``flat``: an Arrow string column as one byte buffer plus offsets, without Python objects.
* ``word_hashes``, ``digests``: hashes by which words and texts are told apart.
* ``Roller``: rolling hashes of byte ranges, by prefix sums modulo 2**64. Different texts of some hundred
  bytes can be made to collide, so these may choose and prune, but never decide that bytes are equal.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a "word" as the contracts define it: all but blank and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset: a temporary folder if the master is local
    (one machine holds everything), else an error, as no machine's own folder is seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unlike(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be unlike all columns of ``df``."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name += "_"
        out.append(name)
        there.add(name.lower())
    return out


def all_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While this holds, Arrow batches have at most so many rows (texts may be long, and a worker holds a batch at a
    time). Only what is written inside is affected; the session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and n + 1 offsets. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int):
    """Row ranges (i, j) of at most ``limit`` bytes, or one row where that row is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row that each belongs to. Words end with their row."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes (XXH3) of byte ranges, a row of two uint64 each."""
    view, digest = memoryview(np.ascontiguousarray(raw)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


#: Words of more bytes than this are hashed one by one.
_LANES = 4


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: lanes of eight bytes mixed one after another; long words by XXH3."""
    size = ends - starts
    out = mix64(size.astype(np.uint64) + np.uint64(0x51ED270B))
    lanes = np.ndarray((max(0, len(raw)),), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    left = np.flatnonzero(size <= 8 * _LANES)
    for k in range(_LANES):
        left = left[size[left] > 8 * k]
        if not len(left):
            break
        spare = np.maximum(8 * (k + 1) - size[left], 0).astype(np.uint64) * np.uint64(8)
        lane = lanes[starts[left] + 8 * k] << spare  # bytes beyond the word fall off
        out[left] = mix64(out[left] ^ lane)
    if len(long := np.flatnonzero(size > 8 * _LANES)):
        out[long] = digests(raw, starts[long], ends[long])[:, 0]
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Roller:
    """Hashes of byte ranges: H(s, e) = sum of t[b_j] * B**(j - s) modulo 2**64, mixed with the length."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**62, dtype=np.uint64)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self._powers = self._grow(1 << 12)

    def _grow(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in (self.base, self.inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return tuple(out)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) + 1 > len(self._powers[0]):
            self._powers = self._grow(1 << int(len(raw) + 1).bit_length())
        h = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self._powers[0][: len(raw)], out=h[1:])
        return h

    def ranges(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (h[ends] - h[starts]) * self._powers[1][starts]
        return mix64(x + (ends - starts).astype(np.uint64))
