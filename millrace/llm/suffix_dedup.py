"""Suffix-array deduplication: removes each byte covered by a string of ``length`` bytes that
also starts anywhere else in the corpus.

1. Sparse suffixes. Every window of ``length`` bytes selects as its anchor the position of the
   least hash among its grams of ``length // 2`` bytes (leftmost of equals). Equal windows
   select equal anchors, so only suffixes that start at anchors (about one byte in a hundred)
   need sorting. An anchor is recorded with its gram's hash, the run of windows that select
   it, and a 128-bit hash of the bytes those windows span (its context).
2. Anchors whose gram occurs once are out. A context that occurs twice settles all its
   windows. Of the other contexts that share a gram, one copy each is *open*. The windows of
   an open context fall into bins by their bytes before the anchor; all windows of a bin have
   a core in common. Bins whose core no other context has cannot repeat and are left out.
3. Open suffixes are range-partitioned by their gram's bytes with sampled splitters (Spark's range
   exchange; ties broken by context, so a very common gram is dealt to several buckets),
   sorted in each bucket by multikey quicksort, as are the reversed bytes before the anchors.
   The prefixes that neighbours share in the two orders say which windows of 400 bytes are
   equal. A group of suffixes that agree on the gram and may reach over a bucket's boundary
   is compared across boundaries: its windows are counted by 128-bit hash over all buckets.
4. Runs of repeated windows become byte intervals, merged per document and cut out.

Defined results: null text is empty (0 bytes); texts shorter than ``length`` keep all bytes.
Rows are told apart by their id and text hash: rows repeated in full are copies of each other,
so their windows repeat. Matches never cross documents; overlaps count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Roller, chunks, digests, flat, materialise, small_batches

LENGTH = 400
CHUNK = 1 << 17
SEEDS = (11, 23)
#: Mixes a place into a hash.
_PLACE = np.uint64(0x9E3779B97F4A7C15)
#: Open suffixes of a bucket (about 600 bytes each).
BUCKET = 10_000

#: A bin holds length // BINS windows.
BINS = 25

_rollers: dict[int, Roller] = {}


def roller(seed: int) -> Roller:
    if seed not in _rollers:
        _rollers[seed] = Roller(seed)
    return _rollers[seed]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values: block prefixes and suffixes."""
    n = len(x) - w + 1
    pad = -len(x) % w
    top = np.uint64(2**64 - 1)
    b = np.concatenate([x, np.full(pad, top, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, off: np.ndarray, length: int):
    """Rows, anchors, first and last window start, gram hash and two context hashes (raw positions)."""
    gram = length // 2
    if len(raw) < length:
        return None
    r = roller(SEEDS[0])
    g = r.ranges(r.prefix(raw), at := np.arange(len(raw) - gram + 1), at + gram)
    key = (g & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    del at
    low = (sliding_min(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int32)
    del key
    # window starts of each row, whose whole window lies in it
    first = np.ones(len(low), bool)
    first[1:] = low[1:] != low[:-1]
    inside = np.zeros(len(low) + 1, np.int32)
    whole = np.flatnonzero(off[1:] - off[:-1] >= length)
    begins, stops = off[whole], off[whole + 1] - length + 1
    inside[begins] += 1
    np.subtract.at(inside, stops, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int32) > 0
    first[begins] = True
    s1 = np.flatnonzero(first & inside)
    if not len(s1):
        return None
    row = np.searchsorted(off, s1, "right") - 1
    # a run of windows ends before the next one, or with its row's windows
    s2 = np.minimum(np.append(s1[1:], len(low)) - 1, off[row + 1] - length)
    a = low[s1].astype(np.int64)
    c = digests(raw, s1, s2 + length)
    # where the anchor stands in its context is part of the context
    return row, a, s1, s2, g[a], c[:, 0] ^ (a - s1).astype(np.uint64) * _PLACE, c[:, 1]


def _row_keys(ids: list, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64 bits that stand for a row: its id and its text."""
    text = digests(raw, off[:-1], off[1:])[:, 0]
    own = np.array([hash_id(x) for x in ids], np.uint64)
    with np.errstate(over="ignore"):
        return ((text * np.uint64(0xD6E8FEB86659FD93)) ^ own).view(np.int64)


def hash_id(x) -> int:
    return int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little")


_ANCHORS = "row_key long, start int, lo int, hi int, gram long, c0 long, c1 long"


def _anchored(length: int):
    out = pa.schema([("row_key", pa.int64()), ("start", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("gram", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64())])

    def run(batches):
        for batch in batches:
            raw_all, off_all = flat(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in chunks(off_all, CHUNK):
                raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
                if (got := anchors(raw, off, length)) is None:
                    continue
                row, a, s1, s2, g, c0, c1 = got
                keys, base = _row_keys(ids[i:j], raw, off)[row], off[row]
                cols = [keys, (a - base).astype(np.int32), (s1 - base).astype(np.int32), (s2 - base).astype(np.int32), g.view(np.int64), c0.view(np.int64), c1.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=out)

    return run


def bin_keys(text: bytes, before: int, length: int) -> np.ndarray:
    """Hashes of the cores of a context's bins that have windows; the low six bits are the bin's number."""
    raw = np.frombuffer(text, np.uint8)
    width, most = max(1, length // BINS), length - length // 2
    least = max(0, length - (len(raw) - before))
    j = np.arange(least // width, min(before, most) // width + 1)
    r = roller(SEEDS[1])
    core = r.ranges(r.prefix(raw), before - np.maximum(j * width, 0), before + length - np.minimum((j + 1) * width - 1, most))
    return (core & ~np.uint64(63)) | j.astype(np.uint64)


def _opened(length: int):
    """Rows (text, doc_id, row_key, spots) to the open suffixes with their bytes and the keys of their bins."""
    out = pa.schema([("suffix", pa.binary()), ("before", pa.binary()), ("gram", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("copies", pa.int64()), ("bins", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = []
            texts = batch.column("text").cast(pa.large_binary())
            for text, spots in zip(texts, batch.column("spots"), strict=True):
                t = text.as_py()
                for p in spots.as_py():
                    bins = bin_keys(t[p["lo"] : p["hi"] + length], p["start"] - p["lo"], length).view(np.int64).tolist()
                    rows.append((t[p["start"] : p["hi"] + length], t[p["lo"] : p["start"]], p["gram"], p["c0"], p["c1"], p["copies"], bins))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return run


def packed(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, padded with zeros to whole words of eight bytes, and their sizes."""
    size = np.array([len(s) for s in strings], np.int64)
    width = int(size.max(initial=0)) // 8 * 8 + 8
    body = np.zeros((len(strings), width), np.uint8)
    body[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return body, size


def multikey_order(body: np.ndarray, size: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Order of byte strings (inside their groups, if given) by multikey quicksort on words of eight bytes: each pass
    sorts all groups that still tie by their next word at once."""
    n = len(size)
    words_of = body.view(">u8")
    order = np.arange(n) if group is None else np.argsort(group, kind="stable")
    if group is None:
        group = np.zeros(n, np.int64)
    else:
        ranked = group[order]
        group = np.searchsorted(ranked, ranked)  # the first place of each group
    open_ = np.arange(n)  # places whose group has more than one member
    for k in range(body.shape[1] // 8):
        if len(open_) < 2:
            break
        words = words_of[order[open_], k].astype(np.uint64)
        spare = np.minimum(size[order[open_]] - 8 * k, 8)  # a string that ends sorts before its extensions
        by = np.lexsort((spare, words, group[open_]))
        order[open_] = order[open_[by]]
        words, spare, g = words[by], spare[by], group[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (g[1:] != g[:-1]) | (words[1:] != words[:-1]) | (spare[1:] != spare[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = open_[tied & (spare == 8)]
    return order


def common_prefixes(body: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each string shares with the one before it in the order; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for lo in range(1, len(order), 1024):
        here, there = order[lo : lo + 1024], order[lo - 1 : lo + 1023][: len(order[lo : lo + 1024])]
        differ = body[here] != body[there]
        same = np.where(differ.any(1), differ.argmax(1), body.shape[1])
        out[lo : lo + 1024] = np.minimum(same, np.minimum(size[here], size[there]))
    return out


def repeated_windows(suffix: list[bytes], before: list[bytes], copies: np.ndarray, live: np.ndarray, length: int):
    """Which windows of the contexts (bytes before the anchor, and from it on) repeat among them.

    Windows whose anchor stands at the same place d are equal where the contexts share ``length - d`` bytes from the
    anchor on and d bytes before it: both are read off the sorted orders of the suffixes and of the reversed bytes
    before them, by the prefixes that neighbours share. Returns the suffixes' order, the groups that agree on the gram
    (by context), first and last start of a repeated window of each context (-1: none), and for each d the windows as
    (contexts, class of equal windows, copies in the class)."""
    gram, width = length // 2, max(1, length // BINS)
    body, size = packed(suffix)
    order = multikey_order(body, size)
    shared = common_prefixes(body, size, order)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(shared < gram)
    body, room = packed([x[::-1] for x in before])
    back = multikey_order(body, room, group)
    shared_back = common_prefixes(body, room, back)
    shared_back[np.flatnonzero(group[back][1:] != group[back][:-1]) + 1] = -1
    first = np.full(len(order), -1, np.int64)
    last = np.full(len(order), -1, np.int64)
    classes = []
    left, right = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    for d in range(length - gram + 1):
        at = np.flatnonzero((d <= room) & (length - d <= size) & (live >> (d // width) & 1 == 1))
        if not len(at):
            continue
        right[order] = np.cumsum(shared < length - d)
        left[back] = np.cumsum(shared_back < d)
        _, of = np.unique(right[at] * (len(order) + 1) + left[at], return_inverse=True)
        total = np.bincount(of, copies[at]).astype(np.int64)
        again = at[total[of] > 1]
        last[again] = np.where(last[again] < 0, room[again] - d, last[again])  # starts fall as d grows
        first[again] = room[again] - d
        classes.append((d, at, of, total))
    return order, group, first, last, classes


_FOUND = "gram long, c0 long, c1 long, a int, b int, w0 long, w1 long, copies long, sure boolean"
_FOUND_ARROW = pa.schema([("gram", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("w0", pa.int64()), ("w1", pa.int64()), ("copies", pa.int64()), ("sure", pa.bool_())])


def _sorted_buckets(length: int):
    """Sorts a bucket's suffixes and finds the windows that repeat in it.

    Each context gets one row (sure) with its first and last window that repeats in the bucket. The first and
    last group may go on in the next bucket: their windows that are single here, and one row for each that
    repeats (a = -1), come with 128-bit hashes for the comparison across boundaries."""

    def run(batches):
        suffix, before, rest = [], [], []
        for batch in batches:
            suffix += batch.column("suffix").to_pylist()
            before += batch.column("before").to_pylist()
            rest.append([np.asarray(batch.column(c)) for c in ("gram", "c0", "c1", "copies", "live")])
        if not suffix:
            return
        g, c0, c1, copies, live = map(np.concatenate, zip(*rest, strict=True))
        order, group, first, last, classes = repeated_windows(suffix, before, copies, live, length)
        at = np.flatnonzero(first >= 0)
        none = np.zeros(len(at), np.int64)
        yield from rows(g[at], c0[at], c1[at], first[at], last[at], none, none, copies[at], np.ones(len(at), bool))
        border = (group == group[order[0]]) | (group == group[order[-1]])
        for d, at, of, total in classes:
            _, one = np.unique(of, return_index=True)  # a member of each class
            one = one[border[at[one]]]
            w, n = at[one], total[of[one]]
            if not len(w):
                continue
            texts = [before[i][len(before[i]) - d :] + suffix[i][: length - d] for i in w.tolist()]
            h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.int64).reshape(-1, 2)
            start = np.where(n > 1, -1, [len(before[i]) - d for i in w.tolist()])
            yield from rows(g[w], c0[w], c1[w], start, start, h[:, 0] ^ np.int64(d), h[:, 1], n, np.zeros(len(w), bool))

    def rows(*cols):
        for i in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], f.type) for x, f in zip(cols, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return run


def _cut(length: int):
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, t, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("spans"), strict=True):
                data = t.as_py() or b""
                runs = merged(spans.as_py() or [])
                rows.append((i, len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(cut_out(data, runs)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out) if rows else pa.RecordBatch.from_pylist([], schema=out)

    return run


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut_out(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in runs:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])


def _keyed():
    def run(batches):
        for batch in batches:
            raw, off = flat(batch.column("text"))
            keys = np.zeros(len(off) - 1, np.int64)
            ids = batch.column("doc_id").to_pylist()
            for i, j in chunks(off, CHUNK):
                keys[i:j] = _row_keys(ids[i:j], raw[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(keys)], names=["doc_id", "text", "row_key"])

    return run


def _joined(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with the list of their key; the lists may be long, so both sides are shuffled, at every size."""
    return texts.join(lists.hint("merge"), "row_key", how)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """docs: (doc_id long, text). (row_key, spans): half-open byte spans of windows that repeat, unmerged."""
    found = materialise(docs.mapInArrow(_anchored(length), _ANCHORS), "suffix-anchors")
    contexts = found.groupBy("gram", "c0", "c1").agg(F.count("*").alias("copies"), F.min(F.struct("row_key", "start", "lo", "hi")).alias("one"))
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.struct("c0", "c1")).alias("a"), F.max(F.struct("c0", "c1")).alias("b"))
    grams = grams.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("several"))
    contexts = materialise(contexts.join(grams, "gram").select("gram", "c0", "c1", "copies", "one", "several"), "suffix-contexts")
    spots = contexts.where("several").groupBy(F.col("one.row_key").alias("row_key")).agg(F.collect_list(F.struct("one.start", "one.lo", "one.hi", "gram", "c0", "c1", "copies")).alias("spots"))
    spots = materialise(spots, "suffix-spots")
    texts = docs.mapInArrow(_keyed(), "doc_id long, text string, row_key long")
    # Rows repeated in full come more than once here; their contexts have copies, so counts stay right.
    holders = _joined(texts, spots, "inner").select("text", "spots")
    opened = materialise(holders.mapInArrow(_opened(length), "suffix binary, before binary, gram long, c0 long, c1 long, copies long, bins array<long>"), "suffix-open")
    cores = opened.select("gram", "c0", "c1", F.explode("bins").alias("core"))
    shared = cores.groupBy("gram", "core").agg(F.count("*").alias("n")).where("n > 1").select("gram", "core")
    # Written before it is grouped, so that the join of a very common core may be dealt anew.
    cores = materialise(cores.join(shared.hint("merge"), ["gram", "core"], "left_semi"), "suffix-cores")
    live = cores.groupBy("gram", "c0", "c1").agg(F.bit_or(F.expr("shiftleft(1L, cast(core & 63 AS int))")).alias("live"))
    opened = materialise(opened.drop("bins").join(live.hint("merge"), ["gram", "c0", "c1"]).select("suffix", "before", "gram", "c0", "c1", "copies", "live"), "suffix-live")
    buckets = max(1, -(-opened.count() // BUCKET))
    # By the whole gram: suffixes that share only a part of it must not be dealt by their contexts, or groups inside a bucket would go on in others.
    dealt = opened.repartitionByRange(buckets, F.substring("suffix", 1, length // 2), F.col("c0"))
    windows = materialise(dealt.mapInArrow(_sorted_buckets(length), _FOUND), "suffix-windows")
    border = windows.where("not sure")
    across = border.groupBy("gram", "w0", "w1").agg(F.sum("copies").alias("n"), F.count("*").alias("k")).where("n > 1 and k > 1").select("gram", "w0", "w1")
    hits = windows.where("sure").select("gram", "c0", "c1", "a", "b")
    hits = hits.unionAll(border.where("a >= 0").join(across, ["gram", "w0", "w1"], "left_semi").select("gram", "c0", "c1", "a", "b"))
    # The windows of one context start at most half a length apart, so those that repeat overlap: one span covers them.
    hits = hits.groupBy("gram", "c0", "c1").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    # A context with two copies is repeated as a whole; one with one copy where its windows are.
    whole = contexts.where("copies > 1").select("gram", "c0", "c1", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    single = hits.join(contexts.where("copies = 1").select("gram", "c0", "c1"), ["gram", "c0", "c1"], "left_semi")
    settled = whole.unionByName(single)
    spans = found.join(settled.hint("merge"), ["gram", "c0", "c1"])
    s = F.col("lo") + F.coalesce("a", F.lit(0))
    e = F.coalesce(F.col("lo") + F.col("b"), F.col("hi")) + F.lit(length)
    return spans.select("row_key", F.struct(s.alias("s"), e.alias("e")).alias("span")).groupBy("row_key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        spans = materialise(repeated_spans(slim, length=length), "suffix-spans")
        texts = slim.mapInArrow(_keyed(), "doc_id long, text string, row_key long")
        out = _joined(texts, spans, "left").select("doc_id", "text", "spans").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        return materialise(out, "suffix-removed")
