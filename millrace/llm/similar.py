"""Near-duplicate documents: by SimHash fingerprints that meet through pigeonring keys, and by similarity of
their word shingles: minwise bands propose, a Hamming test and equal samples order the work, the exact
similarity decides.

With ``tau``, documents link first as ``simhash`` says: fingerprints of three-word shingles, repeats
included, that differ in at most tau bits. These links stand as they are; no similarity is asked of them.
So narrow a width misses most pairs of the similarity below, which links the rest.

A Jaccard similarity of 0.8 leaves about 10 of 64 bits of two fingerprints different, too many for
keys made of equal parts of the ring. So the keys by which documents meet are BANDS runs of ROWS
minwise samples of the shingle set: a pair at 0.8 shares one with probability 0.9996, a higher
similarity more surely. Where two meet,

1. the fingerprints of the shingle sets must differ in at most TAU bits (a pair at 0.8 differs in
   more with probability below 1e-5; at this width the ring's chains prune nothing more);
2. the share of equal samples must reach the similarity less SLACK;
3. of the pairs left only the edges of a maximum spanning forest by that share are returned, and the
   BEST best edges of each document that lead out of what SURE equal samples or more connect. Pairs
   above a threshold connect just what such a forest's edges above it connect; the further edges
   make up for the share being an estimate. No bucket returns all its pairs;
4. the exact similarity of the edges' shingle sets decides, first for each document's best edge,
   then for all edges that still lead from one component to another;
5. in each bucket where several components still meet, the exact similarity decides on every pair
   whose ends are in different ones, whether it passed 1 to 3 or not. So 1 to 3 only save work: no
   two documents that meet and reach the similarity stay apart.

A bucket with more than BUCKET documents is cut into blocks of about BUCKET / 2, and every pair of
blocks meets in a task of its own: no task grows with the bucket, and no pair is left out.

Documents with equal shingle sets are one node, whatever their number. Null text counts as empty;
texts of fewer words than a shingle have their whole word sequence as the only shingle; documents
without words have the same, empty set. component_id of rows that repeat an id and of null ids: as in
``simhash``; which rows stay is decided by row and component, not by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import all_of, materialise, mix64, small_batches, unlike
from millrace.llm.simhash import Ring, components, fingerprints_of, links, majority, shingled

ROWS = 5
BANDS = 20
BUCKET = 2048
TAU = 24
SEGMENTS = 32
RING = Ring(TAU, SEGMENTS)
SLACK = 0.14
SURE = 95
BEST = 8
#: Words of a shingle of the fingerprints that link by themselves, as in ``simhash``.
RING_WORDS = 3
_RNG = np.random.Generator(np.random.PCG64(7))
FLIPS = _RNG.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)
FACTORS = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array, words: int):
    """Pieces of the texts: (rows that have words, their distinct shingle hashes sorted, where each row's begin)."""
    for rows, h, at in shingled(texts, words):
        owner = np.repeat(np.arange(len(rows)), np.diff(np.append(at, len(h))))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[first], owner[first]
        yield rows, h, np.searchsorted(owner, np.arange(len(rows)))


def _nodes_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return np.add.reduceat(mix64(h), at)


_SAMPLED = "doc_id long, k0 long, k1 long, node long, fp long, ring long, sample binary, bands array<long>"


def _sampled(words: int, ring: bool):
    out = pa.schema([("doc_id", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("ring", pa.int64()), ("sample", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sample(batches):
        for batch in batches:
            texts = batch.column("text")
            n = len(texts)
            node, fp = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            least = np.full((n, ROWS * BANDS), 2**64 - 1, np.uint64)
            for rows, h, at in _sets(texts, words):
                node[rows], fp[rows] = _nodes_of(h, at), majority(h, at)
                for i, (flip, factor) in enumerate(zip(FLIPS, FACTORS, strict=True)):
                    least[rows, i] = np.minimum.reduceat((h ^ flip) * factor, at)
            mixed = mix64(least)
            keys = np.zeros((n, BANDS), np.uint64)
            for i in range(ROWS):
                keys = mix64(keys * np.uint64(3) + mixed[:, i::ROWS])
            bands = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(keys.reshape(-1).view(np.int64)))
            bytes_ = np.ascontiguousarray(mixed.astype(np.uint8))
            cells = pa.array([row.tobytes() for row in bytes_], pa.binary())
            own = pa.array(fingerprints_of(texts, RING_WORDS).view(np.int64)) if ring else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k0", "k1")), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), own, cells, bands], schema=out)

    return sample


def _hashed(words: int):
    out = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def hashed(batches):
        for batch in batches:
            for _, h, at in _sets(batch.column("text"), words):
                ends = np.append(at, len(h)).astype(np.int32)
                sets = pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_nodes_of(h, at).view(np.int64)), sets], schema=out)

    return hashed


def forest(fps: np.ndarray, samples: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum spanning forest of the pairs that pass the filters and each row's best edges, as (a, b, equal samples)."""
    n, ring = len(fps), RING
    found = []
    for lo in range(0, n, 64):
        x = fps[lo : lo + 64, None] ^ fps[None, lo:]
        a, b = np.nonzero(ring.any_chain(x))
        keep = a < b
        a, b = a[keep] + lo, b[keep] + lo
        equal = np.concatenate([(samples[a[i : i + 16384]] == samples[b[i : i + 16384]]).sum(1, dtype=np.int16) for i in range(0, len(a), 16384)] or [np.zeros(0, np.int16)])
        keep = equal >= least
        found.append((a[keep], b[keep], equal[keep]))
    a, b, equal = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b, a, -equal))  # the rank makes all weights differ: no cycles below
    a, b, equal = a[order], b[order], equal[order]
    rank = np.arange(len(a))
    sure = int(np.searchsorted(-equal, -SURE, "right"))
    root, taken = _boruvka(np.arange(n), a, b, rank[:sure])
    rank = rank[root[a] != root[b]]
    ends, twice = np.concatenate((a[rank], b[rank])), np.concatenate((rank, rank))
    by_end = np.lexsort((twice, ends))
    ends, twice = ends[by_end], twice[by_end]
    place = np.arange(len(ends)) - np.searchsorted(ends, ends)
    at = np.unique(np.concatenate((taken, _boruvka(root, a, b, rank)[1], twice[place < BEST])))
    return a[at], b[at], equal[at]


def _boruvka(root: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components after adding the edges ``rank`` of (a, b) to those of ``root``, least rank first, and the edges that it takes."""
    taken = [np.zeros(0, np.int64)]
    while len(rank):
        ra, rb = root[a[rank]], root[b[rank]]
        open_ = ra != rb
        rank, ra, rb = rank[open_], ra[open_], rb[open_]
        if not len(rank):
            break
        best = np.full(len(root), len(a))
        np.minimum.at(best, ra, rank)
        np.minimum.at(best, rb, rank)
        edges = np.unique(best[best < len(a)])
        taken.append(edges)
        root = root.copy()
        u, v = root[a[edges]], root[b[edges]]
        while True:  # merge along the chosen edges
            before = root.copy()
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if np.array_equal(root, before):
                break
    return root, np.concatenate(taken)


def _compared(least: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("equal", pa.int32())])

    def compare(batches):
        key, held = None, []

        def done():
            if sum(len(h) for h in held) < 2:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            node = rows.column("node").to_numpy()
            fp = rows.column("fp").to_numpy().view(np.uint64)
            sample = np.frombuffer(b"".join(rows.column("sample").to_pylist()), np.uint8).reshape(len(node), -1)
            a, b, equal = forest(fp, sample, least)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b])), pa.array(equal.astype(np.int32))], schema=out)

        for batch in batches:  # sorted by (band, key, p, q)
            keys = [np.asarray(batch.column(c)) for c in ("band", "key", "p", "q")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for i, j in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if i == j:
                    continue
                now = tuple(k[i] for k in keys)
                if now != key:
                    yield from done()
                    key, held = now, []
                held.append(batch.slice(i, j - i))
        yield from done()

    return compare


def candidates(nodes: DataFrame, *, similarity: float = 0.8) -> DataFrame:
    """Distinct edges (u, v, equal), u < v, of the forests of all buckets of ``nodes`` (node, fp, sample, bands)."""
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = materialise(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "similar-buckets")
    met = keyed.join(sizes.hint("merge"), ["band", "key"])
    blocks = F.ceil(F.col("n") / F.lit(BUCKET // 2)).cast("int")
    # a small bucket is one task; a block of a large one meets every other block in a task
    met = met.withColumn("block", F.when(F.col("n") > BUCKET, F.pmod(F.xxhash64("node"), blocks).cast("int")).otherwise(F.lit(0)))
    others = F.when(F.col("n") > BUCKET, F.array_remove(F.sequence(F.lit(0), blocks - 1), F.col("block"))).otherwise(F.array(F.lit(0)))
    met = met.withColumn("other", F.explode(others)).select("node", "band", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    met = met.join(nodes.select("node", "fp", "sample").hint("merge"), "node")
    dealt = met.repartition("band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q").select("band", "key", "p", "q", "node", "fp", "sample")
    least = int(np.ceil((similarity - SLACK) * ROWS * BANDS - 1e-9))
    return dealt.mapInArrow(_compared(least), "u long, v long, equal int").distinct()


def ring_links(rows: DataFrame, tau: int) -> DataFrame:
    """Edges (u, v) that connect the nodes of ``rows`` (node, ring) as fingerprints do that differ in at most tau bits,
    as a written table."""
    fps = materialise(rows.groupBy(F.col("ring").alias("fp")).agg(F.min("node").alias("least")), "similar-ring")
    end = lambda c: fps.select(F.col("fp").alias(f"f{c}"), F.col("least").alias(c))
    apart = links(fps.select("fp"), tau=tau).distinct().toDF("fu", "fv").join(end("u"), "fu").join(end("v"), "fv").select("u", "v")
    alike = rows.select("node", F.col("ring").alias("fu")).distinct().join(end("u"), "fu").select("u", F.col("node").alias("v"))
    return materialise(apart.unionByName(alike).where("u <> v").distinct(), "similar-ring-links")


def verified(edges: DataFrame, nodes: DataFrame, texts: DataFrame, *, words: int, similarity: float) -> DataFrame:
    """The edges (u, v) whose shingle sets reach the similarity, as a written table."""
    need = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "least_id"), "node").select(F.col("least_id").alias("__id")).distinct()
    those = texts.join(need, texts["doc_id"].eqNullSafe(need["__id"]), "left_semi").select("text")
    sets = materialise(those.mapInArrow(_hashed(words), "node long, shingles array<long>"), "similar-sets")
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    pairs = edges.select("u", "v").join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("sum"))
    ok = F.col("both") >= F.lit(similarity) * (F.col("sum") - F.col("both")) - F.lit(1e-9)
    return materialise(pairs.where(ok).select("u", "v").distinct(), "similar-verified")


def joined_sets(node: np.ndarray, root: np.ndarray, values: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that connect rows of different roots as all pairs of sufficient exact similarity do.

    ``values`` holds the sets one after another, ``at`` where each begins, and the end."""
    order = np.argsort(np.diff(at), kind="stable")
    size = np.diff(at)[order]
    _, values = np.unique(values, return_inverse=True)
    values = np.concatenate([values[at[i] : at[i + 1]] for i in order])
    at = np.concatenate([[0], np.cumsum(size)])
    node = node[order]
    _, comp = np.unique(root[order], return_inverse=True)
    flag = np.zeros(int(values.max(initial=0)) + 1, bool)
    u, v = [], []
    # pairs inside the largest component need no look
    for i in np.flatnonzero(comp != np.bincount(comp).argmax()):
        lo = int(np.searchsorted(size, similarity * size[i] - 1e-6))
        hi = int(np.searchsorted(size, size[i] / similarity + 1e-6, "right")) if similarity > 0 else len(size)
        if (comp[lo:hi] == comp[i]).all():
            continue
        mine = values[at[i] : at[i + 1]]
        flag[mine] = True
        both = np.add.reduceat(flag[values[at[lo] : at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)
        flag[mine] = False
        for j in np.flatnonzero(both >= similarity * (size[lo:hi] + size[i] - both) - 1e-9) + lo:
            if comp[j] != comp[i]:
                u.append(node[i])
                v.append(node[j])
                comp[comp == comp[j]] = comp[i]
    return np.array(u, np.int64), np.array(v, np.int64)


def _decided(similarity: float):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def decide(batches):
        key, held = None, []

        def done():
            if sum(len(h) for h in held) < 2:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            sets = rows.column("shingles").combine_chunks()
            at = np.asarray(sets.offsets, np.int64)
            u, v = joined_sets(rows.column("node").to_numpy(), rows.column("root").to_numpy(), np.asarray(sets.flatten()), at - at[0], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=out)

        for batch in batches:  # sorted by (band, key, p, q)
            keys = [np.asarray(batch.column(c)) for c in ("band", "key", "p", "q")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for i, j in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if i == j:
                    continue
                now = tuple(k[i] for k in keys)
                if now != key:
                    yield from done()
                    key, held = now, []
                held.append(batch.slice(i, j - i))
        yield from done()

    return decide


def undecided(nodes: DataFrame, roots: DataFrame, texts: DataFrame, *, words: int, similarity: float) -> DataFrame:
    """Edges (u, v) that connect the components ``roots`` as all pairs do that meet in a bucket and reach the similarity."""
    placed = nodes.join(roots.hint("merge"), "node", "left").select("node", "bands", F.coalesce("root", "node").alias("root"))
    keyed = materialise(placed.select("node", "root", F.posexplode("bands").alias("band", "key")), "similar-keyed")
    parts = keyed.groupBy("band", "key", "root").agg(F.count("*").alias("c")).groupBy("band", "key")
    several = parts.agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.max(F.struct("c", "root")).alias("top")).where("k > 1")
    several = materialise(several.select("band", "key", "n", "top"), "similar-several")
    met = keyed.join(several.hint("merge"), ["band", "key"])
    half = F.lit(BUCKET // 2)
    # the largest component of a large bucket has blocks of its own, which need not meet each other
    first = F.ceil(F.col("top.c") / half).cast("int")
    all_ = first + F.ceil((F.col("n") - F.col("top.c")) / half).cast("int")
    large, top = F.col("n") > BUCKET, F.col("root") == F.col("top.root")
    by = F.xxhash64("node")
    met = met.withColumn("block", F.when(~large, F.lit(0)).when(top, F.pmod(by, first).cast("int")).otherwise(first + F.pmod(by, all_ - first).cast("int")))
    others = F.when(~large, F.array(F.lit(0))).when(top, F.sequence(first, all_ - 1)).otherwise(F.array_remove(F.sequence(F.lit(0), all_ - 1), F.col("block")))
    met = met.withColumn("other", F.explode(others)).select("node", "root", "band", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    met = materialise(met, "similar-met")
    need = met.select("node").distinct().join(nodes.select("node", "least_id").hint("merge"), "node").select(F.col("least_id").alias("__id")).distinct()
    those = texts.join(need, texts["doc_id"].eqNullSafe(need["__id"]), "left_semi").select("text")
    sets = materialise(those.mapInArrow(_hashed(words), "node long, shingles array<long>").dropDuplicates(["node"]), "similar-met-sets")
    dealt = met.join(sets.hint("merge"), "node").repartition("band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q")
    return dealt.select("band", "key", "p", "q", "node", "root", "shingles").mapInArrow(_decided(similarity), "u long, v long").distinct()


def row_key(docs: DataFrame, *names: str) -> list:
    """Hashes of all columns of a row that can be hashed, of 64 bits each, under these names."""
    cols = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    values = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(i), *values).alias(n) for i, n in enumerate(names)]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tau: int | None = None) -> DataFrame:
    """One row a document: doc_id, node (of equal shingle sets), component_id (least id reachable), root (of the
    component, also where ids are null or shared) and k0, k1 (of the row)."""
    with small_batches(docs.sparkSession):
        return _components(docs, id_col, text_col, words, similarity, tau)


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, tau: int | None) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_key(docs, "k0", "k1"))
    rows = materialise(texts.mapInArrow(_sampled(words, tau is not None), _SAMPLED), "similar-rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("fp", "sample", "bands")])
    nodes = materialise(nodes, "similar-nodes")
    edges = materialise(candidates(nodes, similarity=similarity), "similar-edges")
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("y"), "equal").unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y"), "equal"))
    best = ends.groupBy("x").agg(F.max(F.struct("equal", "y")).alias("m")).select(F.least("x", "m.y").alias("u"), F.greatest("x", "m.y").alias("v"))
    best = materialise(best.distinct(), "similar-best")
    found = verified(best, nodes, texts, words=words, similarity=similarity)
    if tau is not None:
        found = found.unionByName(ring_links(rows, tau))
    roots = materialise(components(found), "similar-roots")
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    left = edges.join(best, ["u", "v"], "left_anti").join(side("u"), "u", "left").join(side("v"), "v", "left")
    left = materialise(left.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v"), "similar-left")
    if not left.isEmpty():
        found = found.unionByName(verified(left, nodes, texts, words=words, similarity=similarity))
        roots = materialise(components(found), "similar-roots")
    more = materialise(undecided(nodes, roots, texts, words=words, similarity=similarity), "similar-more")
    if not more.isEmpty():
        roots = materialise(components(found.unionByName(more)), "similar-roots")
    placed = nodes.select("node", "least_id").join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    comp = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(placed.join(comp, "root").select("node", "root", "component_id"), "similar-named")
    return rows.select("doc_id", "node", "k0", "k1").join(named.hint("merge"), "node").select("doc_id", "node", "component_id", "root", "k0", "k1")


def distinct_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tau: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each component, that of the least id (a null id only
    where there is no other; of equal ids the least row key), whatever ids components share.

    Documents link if their fingerprints differ in at most ``tau`` bits (if given), or the sets of their word
    shingles have a Jaccard similarity of at least ``similarity`` (see the module). Documents without words have the same, empty set and link."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity, tau=tau)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1")).alias("m"))
    k0, k1 = unlike(docs, "__k0", "__k1")
    keep = first.select(F.col("m.k0").alias(k0), F.col("m.k1").alias(k1))
    tagged = docs.select("*", *row_key(docs, k0, k1))
    # rows that are left with one key are equal in all columns
    return tagged.join(keep, [k0, k1], "left_semi").dropDuplicates([k0, k1]).select(*all_of(docs))
