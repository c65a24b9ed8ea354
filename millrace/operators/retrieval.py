"""Retrieval: lines of documents and pages, chunks, BM25, fusion and assembled contexts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# Tags that end a line, and marks that end a sentence in extracted lines.
BLOCK_TAGS = "p|div|br|li|h[1-6]|tr|td|title|article|section|ul|ol|table|head|body"
FINAL_MARKS = "。！？.!?…；;"

#: Pairs of a query and a term up to which BM25 broadcasts them.
FEW_TERMS = 1_000_000


def html_lines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, line_no, line): text lines of HTML; scripts, styles, comments and tags go."""
    x = F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(x, "\n"), lambda t: T.normalize_join(t)), lambda t: t != "")
    return pages.select(key, F.posexplode(lines).alias("line_no", "line"))


def markdown_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    x = F.regexp_replace(F.col(text), r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+)", "")
    x = F.regexp_replace(x, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"(\*\*|__|`)", "")
    return df.select(key, F.posexplode(F.filter(F.split(x, "\r?\n"), lambda t: F.trim(t) != "")).alias("line_no", "line"))


def merged_lines(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Successive lines of a document joined until one ends a sentence: (key, part, text)."""
    w = Window.partitionBy(key).orderBy(order)
    ends = F.col(line).rlike(f"[{FINAL_MARKS}]\\s*$").cast("int")
    part = F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tagged = lines.withColumn("part", part)
    return tagged.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "").alias("text"))


def _spans(sizes: np.ndarray, gap: int, size: int, ends: np.ndarray | None, least: int) -> Iterator[tuple[int, int]]:
    """Ranges of units (words or sentences) that fill chunks one after another, from running totals of their sizes.

    A chunk takes units while the next one's size fits on top of what it holds (units and the gaps between them); with
    ``ends``, it also stops at the first such unit that brings it above ``least``."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    # with a gap of one, unit k fits a chunk from i on if upto[k + 1] - upto[i] + (k - i - 1) <= size
    reach = upto[1:] + gap * np.arange(len(sizes))
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(reach, size + upto[i] + gap * (i + 1), "right")))
        if ends is not None:
            k = np.searchsorted(ends, np.searchsorted(upto, upto[i] + least, "right") - 1)
            if k < len(ends) and i <= ends[k] < j:
                j = int(ends[k]) + 1
        yield i, j
        i = j


def split_chunks(text: str, size: int, overlap: int, segment: Callable[[str], list[str]] | None = None) -> list[str]:
    """Chunks of about ``size`` characters at sentence ends; each but the last is followed by the next one's start.

    ``segment`` cuts Chinese text into words; without one, each character is a word. A unit longer than a chunk is
    a chunk of its own."""
    if re.search("[\u4e00-\u9fff]", text):
        units = list(segment(text)) if segment else list(text)
        ends = np.flatnonzero([w[-1:] in "\n。！？；…" for w in units])
        spans = _spans(np.array([len(w) for w in units]), 0, size, ends, size - overlap)
        chunks = ["".join(units[i:j]).strip() for i, j in spans]
    else:
        units = re.split(r"(?<=[.!?])\s+", text.replace("\n", " "))
        units = units[1:] if units[0] == "" else units
        chunks = [" ".join(units[i:j]) for i, j in _spans(np.array([len(x) for x in units], np.int64), 1, size, None, 0)]
        chunks = [c for c in chunks if c]
    followers = [*chunks[1:], ""][: len(chunks)]
    return [f"{a} {b[:overlap]}".strip() if overlap > 0 and k + 1 < len(chunks) else a for k, (a, b) in enumerate(zip(chunks, followers, strict=True))]


def chunked(docs: DataFrame, key: str, text: str, size: int = 250, overlap: int = 50, segment: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(key, chunk_no, chunk) in Arrow batches; the rule carries state from sentence to sentence."""
    slim = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, c) for k, t in zip(frame[key], frame["text"], strict=True) for i, c in enumerate(split_chunks(t, size, overlap, segment))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    return slim.mapInPandas(run, f"{key} {slim.schema[key].dataType.simpleString()}, chunk_no int, chunk string")


def _vector_blocks(rows: int, cells: int = 1 << 18) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: rows (id, vector) to blocks (dim, ids, body) of vectors of one length, in order of id; null vectors have dim -1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, body = pa.concat_arrays([x for x, _ in held[dim]]), np.concatenate([x for _, x in held[dim]])
            order = pc.sort_indices(ids)
            held[dim] = []
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(order))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), lists, pa.array([body[order.to_numpy()].tobytes()], pa.binary())], ["dim", "ids", "body"])

        for batch in batches:
            ids, v = batch.columns
            dims = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            values = v.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(dims, 0)) - np.maximum(dims, 0)
            for dim in np.unique(dims).tolist():
                at, most = np.flatnonzero(dims == dim), max(1, min(rows, cells // max(1, dim)))
                for i in range(0, len(at), most):
                    some = at[i : i + most]
                    held.setdefault(dim, []).append((ids.take(pa.array(some)), values[starts[some][:, None] + np.arange(max(0, dim))]))
                    if sum(len(x) for x, _ in held[dim]) >= most:
                        yield block(dim)
        for dim in held:
            if held[dim]:
                yield block(dim)

    return pack


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component on, as SQL does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _block_scores(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded cosine of what may be among each row's k best; columns stand in order of id.

    A matrix product, off by far less than 1e-7, chooses all that come within rounding of the k-th best; these are computed anew one by one."""
    qn, cn = np.sqrt(_summed(q, q)), np.sqrt(_summed(c, c))
    near = (q @ c.T) / np.maximum(qn[:, None] * cn, 1e-12)
    odd = ~np.isfinite(near) & ~own
    near[odd | own] = -np.inf
    kth = np.partition(near, near.shape[1] - k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
    rows, cols = np.nonzero((near >= kth[:, None] - 2e-6) & ~own | odd)
    score = np.empty(len(rows))
    for i in range(0, len(rows), 1 << 14):
        r, s = rows[i : i + (1 << 14)], cols[i : i + (1 << 14)]
        score[i : i + (1 << 14)] = _summed(q[r], c[s]) / np.maximum(qn[r] * cn[s], 1e-12)
    scaled = np.abs(score) * 1e6
    whole = np.trunc(scaled)
    score = np.copysign((whole + (scaled - whole >= 0.5)) / 1e6, score) + 0.0  # half away from zero
    nan = np.isnan(score)
    order = np.lexsort((cols, -np.where(nan, 0, score), ~nan, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], cols[best], score[best]


def _block_pairs(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: pairs of blocks to (query, row, score, group), the k best of each query in each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(batch.num_rows):
                q_dim, q_ids, q_body, dim, ids, body, b = (batch.column(i)[t] for i in range(7))
                q_ids, ids, q_dim, dim = q_ids.values, ids.values, q_dim.as_py(), dim.as_py()
                known = q_ids.unique()
                q_at, at = (pc.fill_null(pc.index_in(x.cast(known.type), known), -1).to_numpy(zero_copy_only=False) for x in (q_ids, ids))
                own, same = np.zeros((len(q_ids), len(ids)), bool), np.flatnonzero(at >= 0)
                own[:, same] = q_at[:, None] == at[same]
                if q_dim == dim >= 0:
                    vectors = (np.frombuffer(x.as_buffer(), np.float64).reshape(n, dim) for x, n in ((q_body, len(q_ids)), (body, len(ids))))
                    with np.errstate(all="ignore"):
                        r, c, score = _block_scores(*vectors, own, k)
                    score = pa.array(score)
                else:  # no cosine: null, as in SQL; ids decide
                    r, c = np.nonzero(~own & (np.cumsum(~own, axis=1) <= k))
                    score = pa.nulls(len(r), pa.float64())
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(r)), ids.take(pa.array(c)), score, pa.array(np.full(len(r), b.as_py(), np.int32))], ["__q", "__c", "score", "__b"])

    return run


def cosine_topk(queries: DataFrame, corpus: DataFrame, qid: str, cid: str, vector: str, k: int, blocks: int = 16) -> DataFrame:
    """(qid, cid, score, rank): stated queries against all rows. Both go in packed blocks, dealt to groups by an equi-join;
    each pair of blocks is one matrix product."""
    sides = []
    for df, key, rows in ((queries, qid, 512), (corpus, cid, 4096)):
        v = F.col(vector).cast("array<double>")
        slim = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.when(F.forall(v, lambda x: x.isNotNull()), v).alias("v"))
        kind = slim.schema["id"].dataType.simpleString()
        sides.append((slim.mapInArrow(_vector_blocks(rows), f"dim int, ids array<{kind}>, body binary"), kind))
    (q, q_kind), (c, c_kind) = sides
    q = q.select(F.col("dim").alias("__qd"), F.col("ids").alias("__qi"), F.col("body").alias("__qv"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b"))
    c = c.withColumn("__b", F.pmod(F.xxhash64("ids", "body"), F.lit(blocks)).cast("int"))
    tiles = c.join(q.hint("shuffle_hash"), "__b").select("__qd", "__qi", "__qv", "dim", "ids", "body", "__b")
    scored = tiles.mapInArrow(_block_pairs(k), f"__q {q_kind}, __c {c_kind}, score double, __b int")
    for part in (["__q", "__b"], ["__q"]):  # the best of each block, then of all
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.col("score").desc(), "__c"))).where(F.col("rank") <= k)
    return scored.select(F.col("__q").alias(qid), F.col("__c").alias(f"match_{cid}"), "score", "rank")


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, qid: str, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, doc_id, score): only terms of the queries are joined; lengths and document frequencies cover all.

    Documents are dealt by id once; where they lie, their terms are counted and their scores summed, so that neither is
    exchanged. Queries are broadcast unless they have more than ``FEW_TERMS`` terms, each query's counted apart."""
    q = queries.select(qid, F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    near = F.broadcast if q.limit(FEW_TERMS + 1).count() <= FEW_TERMS else lambda x: x
    split = lambda df: df.select(doc_id, F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("t")).withColumn("len", F.size("t"))
    # each document has the empty term once, too, which gives the number of documents and their length in the same pass
    known = q.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    df = split(docs).select("len", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("term")).join(near(known), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("all"))
    of_all = lambda c: F.max(F.when(F.col("term") == "", F.col(c))).over(Window.partitionBy(F.lit(0)))
    df = df.select("term", "df", of_all("df").alias("n"), (of_all("all") / of_all("df")).alias("avg")).where("term <> ''")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = q.join(df, "term").select(qid, "term", idf.alias("idf"), "avg")
    # explode_outer: explode would have texts split before they are dealt, too, to leave out those without terms
    tf = split(docs.select(doc_id, text).repartition(F.col(doc_id))).select(doc_id, "len", F.explode_outer("t").alias("term")).join(near(known), "term", "left_semi").groupBy("term", doc_id, "len").agg(F.count("*").alias("tf"))
    s = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return tf.join(near(weights), "term").groupBy(qid, doc_id).agg(F.sum(s).alias("score"))


def fused(dense: DataFrame, sparse: DataFrame, qid: str, doc_id: str, weights: tuple[float, float] = (0.5, 0.5), c: float = 2.0) -> DataFrame:
    """Reciprocal-rank fusion of two ranked tables (qid, doc_id, rank)."""
    part = lambda df, w: df.select(qid, doc_id, (F.lit(w) / (F.col("rank") + c)).alias("s"))
    return part(dense, weights[0]).unionByName(part(sparse, weights[1])).groupBy(qid, doc_id).agg(F.sum("s").alias("score"))


def contexts(ranked: DataFrame, qid: str, chunk: str, most: int = 4000) -> DataFrame:
    """(qid, context): numbered chunks in rank order, cut to ``most`` characters."""
    lists = ranked.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", chunk))), lambda x: x[chunk]).alias("c"))
    return lists.select(qid, F.substring(T.number_contexts(F.col("c")), 1, most).alias("context"))
