"""SimHash near-deduplication with pigeonring filtering.

Fingerprints. Each text (A-Z lower-cased) is split into words; a bit is 1 if it is set in
over half of the XXH64 hashes (seed 42) of its word shingles, repeats included. Texts of
fewer words than a shingle hash their whole word sequence; texts without words get zero.

Links. Two fingerprints link if they differ in at most ``tau`` bits. Pigeonring: lay the 64
bits out as a ring of ``segments`` parts; if the total difference is at most tau, some part
starts a chain in which, for every length l, the first l parts differ in at most
floor(l * tau / segments) bits. The lengths for which that bound is 0 give an exact key (a
run of equal parts), by which fingerprints meet; the further lengths prune before the full
Hamming check. Only distinct fingerprints are matched, so copies cost nothing.

Large buckets. A bucket with more than BUCKET fingerprints is dealt anew by choices of
further parts that must be equal (at most tau of the parts outside the run can differ), so
that what is left free has few bits; that path is exact, too. In a bucket only the edges of
a spanning forest are returned, never all pairs. Components come from alternating large-star
and small-star rounds over tables in the shared folder.

Defined results: null text counts as empty; all texts without words share fingerprint zero
and link. Rows that repeat an id share the least id reachable; a null id is never the
smallest unless the component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, flat, lowered, materialise, word_bounds

SEED = 42
BUCKET = 4096
CHUNK = 1 << 18
ROUNDS = 60


def shingled(texts: pa.Array, words: int):
    """Pieces of the texts: (rows that have words, shingle hashes in order, where each row's begin)."""
    raw_all, off_all = flat(texts)
    for i, j in chunks(off_all, CHUNK):
        raw = lowered(raw_all[off_all[i] : off_all[j]])
        starts, ends, owner = word_bounds(raw, off_all[i : j + 1] - off_all[i])
        if not len(starts):
            continue
        # All words one after another with a single blank between: a shingle is then one slice.
        size = ends - starts
        at = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int(at[-1] + size[-1] + 1), 32, np.uint8)
        src = np.repeat(starts - at, size) + (pos := np.arange(len(joined))[_inside(at, size, len(joined))])
        joined[pos] = raw[src]
        text = joined.tobytes()
        docs, first, count = np.unique(owner, return_index=True, return_counts=True)
        n_sh = np.maximum(count - words + 1, 1)
        span = np.minimum(count, words)
        sh = np.repeat(first - (np.cumsum(n_sh) - n_sh), n_sh) + np.arange(int(n_sh.sum()))
        b, e = at[sh], (at + size)[sh + np.repeat(span, n_sh) - 1]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(text[x:y], SEED) for x, y in zip(b.tolist(), e.tolist(), strict=True)), np.uint64, len(b))
        yield i + docs, h, np.cumsum(n_sh) - n_sh


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each row: bits set in over half of its hashes."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    n_sh = np.diff(np.append(at, len(h)))
    return ((2 * ones > n_sh[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fingerprints_of(texts: pa.Array, words: int) -> np.ndarray:
    """uint64 fingerprint of every text."""
    out = np.zeros(len(texts), np.uint64)
    for rows, h, at in shingled(texts, words):
        out[rows] = majority(h, at)
    return out


def _inside(at: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """True where a position belongs to a word rather than to the blank after it."""
    inside = np.ones(n, bool)
    inside[at + size] = False
    return inside


def _fingerprinted(words: int):
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def fingerprint(batches):
        for batch in batches:
            fp = fingerprints_of(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], schema=out)

    return fingerprint


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprinted(words), "doc_id long, fp long")


class Ring:
    """Layout of the ring for a number of segments and a Hamming threshold."""

    def __init__(self, tau: int, segments: int):
        if not 0 <= tau < segments or 64 % segments:
            raise ValueError("segments must divide 64 and exceed tau")
        self.tau, self.m, self.width = tau, segments, 64 // segments
        self.bound = [length * tau // segments for length in range(segments + 1)]
        self.run = sum(1 for length in range(1, segments + 1) if self.bound[length] == 0)
        seg = (1 << self.width) - 1
        self.masks = np.array([np.uint64(seg << (self.width * i)) for i in range(segments)])
        self.run_masks = np.array([np.bitwise_or.reduce(self.masks[[(i + x) % segments for x in range(self.run)]]) for i in range(segments)])

    @cached_property
    def choices(self) -> list[tuple[int, ...]]:
        """Parts outside a run of which some choice must be equal; only large buckets ask for them."""
        free = self.m - self.run
        return list(combinations(range(self.run, self.m), free - self.tau)) if free > self.tau else [()]

    def second_masks(self, start: int) -> np.ndarray:
        """Masks of the run and of each choice of parts outside it that may all be equal."""
        return np.array([self.run_masks[start] | np.bitwise_or.reduce(self.masks[[(start + x) % self.m for x in c]]) if c else self.run_masks[start] for c in self.choices])

    def chained(self, start: int, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, column) of fingerprints that agree on the run from ``start`` and pass all longer lengths of the
        chain but the last, which is the full check. Each length looks only at what the ones before left."""
        part = (start + self.run) % self.m
        total = np.bitwise_count((rows[:, None] ^ columns[None]) & self.masks[part])
        a, b = np.nonzero(total <= self.bound[min(self.run + 1, self.m)])
        total = total[a, b]
        for length in range(self.run + 2, self.m):
            total = total + np.bitwise_count((rows[a] ^ columns[b]) & self.masks[(start + length - 1) % self.m])
            keep = total <= self.bound[length]
            a, b, total = a[keep], b[keep], total[keep]
        return a, b

    def linked(self, start: np.ndarray | int, x: np.ndarray) -> np.ndarray:
        """Whether the differences x pass the chain test from ``start`` and then the full check."""
        ok = np.ones(x.shape, bool)
        total = np.zeros(x.shape, np.uint8)
        for length in range(1, self.m + 1):
            total += np.bitwise_count(x & self.masks[(start + length - 1) % self.m])
            ok &= total <= self.bound[length]
        return ok

    def any_chain(self, x: np.ndarray) -> np.ndarray:
        """Whether the differences x pass the full check and, from some start, the chain test."""
        ok = np.bitwise_count(x) <= self.tau
        at = np.nonzero(ok)
        near = x[at]
        passed = np.zeros(near.shape, bool)
        for start in range(self.m):
            left = np.flatnonzero(~passed)
            if not len(left):
                break
            passed[left] = self.linked(start, near[left])
        ok[at] = passed
        return ok


def _forest(fps: np.ndarray, ring: Ring, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, root) of a spanning forest of the links in a bucket of distinct fingerprints."""
    n = len(fps)
    root = np.arange(n)

    def find(i: np.ndarray) -> np.ndarray:
        while True:
            up = root[i]
            if np.array_equal(up, i):
                return i
            root[i] = root[up]
            i = up

    for lo in range(0, n, 256):
        # only pairs that pass the chain's further lengths reach the full count
        a, b = ring.chained(start, fps[lo : lo + 256], fps[lo:])
        keep = a < b
        a, b = a[keep] + lo, b[keep] + lo
        keep = np.bitwise_count(fps[a] ^ fps[b]) <= ring.tau
        a, b = a[keep], b[keep]
        while len(a):
            ra, rb = find(a), find(b)
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
    top = find(np.arange(n))
    out = np.flatnonzero(top != np.arange(n))
    return fps[out], fps[top[out]]


def _linked(tau: int, segments: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def link(batches):
        ring = Ring(tau, segments)
        start, key, held = None, None, []

        def done():
            if held and (fps := np.concatenate(held)).size > 1:
                u, v = _forest(fps.view(np.uint64), ring, start % ring.m)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=out)

        for batch in batches:  # sorted by (start, key)
            s, k, f = (np.asarray(batch.column(c)) for c in ("start", "key", "fp"))
            cut = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1
            for i, j in zip([0, *cut], [*cut, len(s)], strict=True):
                if i == j:
                    continue
                if (s[i], k[i]) != (start, key):
                    yield from done()
                    start, key, held = s[i], k[i], []
                held.append(f[i:j])
        yield from done()

    return link


def links(fps: DataFrame, *, tau: int = 2, segments: int = 8) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fps`` (fp) as their links do."""
    ring = Ring(tau, segments)
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    masks = F.array(*[F.lit(signed(x)) for x in ring.run_masks])
    keyed = fps.select("fp", F.posexplode(masks).alias("start", "mask")).select("fp", "start", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = materialise(sizes, "simhash-buckets")
    small = keyed.join(sizes.where(F.col("n") <= BUCKET).select("start", "key"), ["start", "key"], "left_semi")
    big = keyed.join(sizes.where(F.col("n") > BUCKET).select("start", "key"), ["start", "key"], "left_semi")
    again = F.element_at(F.array(*[F.array(*[F.lit(signed(x)) for x in ring.second_masks(i)]) for i in range(ring.m)]), F.col("start") + 1)
    big = big.select("fp", "start", F.posexplode(again).alias("choice", "mask"))
    big = big.select("fp", (F.col("start") + F.lit(ring.m) * (F.col("choice") + 1)).alias("start"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    both = small.select("fp", "start", "key").unionByName(big)
    dealt = both.repartition("start", "key").sortWithinPartitions("start", "key")
    return dealt.select("start", "key", "fp").mapInArrow(_linked(tau, segments), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    Large-star and small-star rounds until nothing changes."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-0")
    before = None
    for i in range(ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), f"cc-{i + 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tau: int = 2, segments: int = 8) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (least id reachable)."""
    rows = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "simhash-fp")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = materialise(components(links(fps.select("fp"), tau=tau, segments=segments)), "simhash-roots")
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    comp = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(placed.join(comp, "root").select(F.col("fp").alias("fp2"), "component_id"), "simhash-named")
    return rows.join(named.hint("merge"), F.col("fp") == F.col("fp2")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
