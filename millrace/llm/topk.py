"""Exact top-k search by inner product: tiled matrix products of queries and shards.

Queries and base rows are packed into blocks, one Parquet row each. Both sides are dealt to a
grid, sized from the numbers of blocks, where each query block meets every shard block once
through an equi-join, so neither side is broadcast or collected; each tile is one matrix product, from which the k best per query are
selected. Per-query top lists are then merged in a tree: inside a task, per group of
shards, and at last per query.

Defined results: vectors that are null, or hold null or non-finite components, or have a
null id, take no part. Vectors are compared with vectors of the same length only. Equal
scores go to the smaller id. A candidate that bears the query's id is the query's own row.
If a query id repeats, its least vector is the query; repeated base rows are candidates
each. An empty table gives an empty result. Scores beyond 64 bits saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, small_batches

QUERY_BLOCK = 1024
SHARD_BLOCK = 8192
#: Blocks that a task of the grid holds: query blocks in memory, shard blocks streamed past them.
QUERIES_A_TASK = 4
SHARDS_A_TASK = 8
#: Groups of shards at least, as far as there are shards.
LEAST_GROUPS = 24


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): v holds floor(scale * x) of every component x, x as double, saturated to 64 bits."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
        .select("id", F.transform("x", lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    )


_BLOCKS = "dim int, n int, ids binary, body binary"


def _packed(rows_per_block: int):
    """mapInArrow: rows (id, v) to blocks of vectors of equal length, sorted by id."""

    def pack(batches):
        held: dict[int, list] = {}

        def block(dim: int):
            ids = np.concatenate([x[0] for x in held[dim]])
            body = np.concatenate([x[1] for x in held[dim]])
            order = np.argsort(ids, kind="stable")
            held[dim] = []
            return pa.RecordBatch.from_pydict(
                {"dim": [dim], "n": [len(ids)], "ids": [ids[order].tobytes()], "body": [body[order].tobytes()]},
                schema=pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("body", pa.binary())]),
            )

        for batch in batches:
            v = batch.column("v")
            ids = np.asarray(batch.column("id"), np.int64)
            dims = np.asarray(v.value_lengths(), np.int64)
            values = np.asarray(v.flatten(), np.int64)
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), rows_per_block):
                    some = at[i : i + rows_per_block]
                    held.setdefault(int(dim), []).append((ids[some], values[starts[some][:, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held[int(dim)]) >= rows_per_block:
                        yield block(int(dim))
        for dim in held:
            if held[dim]:
                yield block(dim)

    return pack


def _products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """All inner products, exact in int64 (saturated beyond)."""
    top = lambda a: float(np.abs(a.astype(np.float64)).max()) if a.size else 0.0
    most = top(q) * top(s) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ s.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ s.T
    exact = q.astype(object) @ s.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _tile_best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of each row's k best; columns stand in order of id, so ties go to the left."""
    m, n = scores.shape
    if n > 4 * k:  # all above the k-th score, and enough of the first that equal it
        low = np.iinfo(np.int64).min
        masked = np.where(own, low, scores)
        kth = np.partition(masked, n - k, axis=1)[:, n - k]
        above = masked > kth[:, None]
        equal = (masked == kth[:, None]) & ~own
        need = k - above.sum(1)
        equal &= np.cumsum(equal, axis=1) <= need[:, None]
        r, c = np.nonzero(above | equal)
    else:
        r, c = np.nonzero(~own)
    return r, c, scores[r, c]


def _searched(k: int):
    """mapInArrow over tiles (query block, shard block); keeps one top list per query and shard group."""
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("grp", pa.int32())])

    def best(qid, vid, score, grp):
        order = np.lexsort((vid, ~score, qid, grp))  # ~x falls as x grows, without overflow
        qid, vid, score, grp = qid[order], vid[order], score[order], grp[order]
        new = np.ones(len(qid), bool)
        new[1:] = (qid[1:] != qid[:-1]) | (grp[1:] != grp[:-1])
        at = np.arange(len(qid))
        rank = at - np.maximum.accumulate(np.where(new, at, 0))
        keep = rank < k
        return qid[keep], vid[keep], score[keep], grp[keep]

    def search(batches):
        held, rows = [], 0
        for batch in batches:
            for t in batch.to_pylist():
                q = np.frombuffer(t["q_body"], np.int64).reshape(t["q_n"], t["dim"])
                s = np.frombuffer(t["body"], np.int64).reshape(t["n"], t["dim"])
                qi, si = np.frombuffer(t["q_ids"], np.int64), np.frombuffer(t["ids"], np.int64)
                for i in range(0, len(qi), 256):
                    part = slice(i, i + 256)
                    r, c, score = _tile_best(_products(q[part], s), qi[part][:, None] == si[None, :], k)
                    held.append((qi[part][r], si[c], score, np.full(len(r), t["grp"], np.int32)))
                    rows += len(r)
                if rows > 500_000:
                    held = [best(*map(np.concatenate, zip(*held, strict=True)))]
                    rows = len(held[0][0])
                    if rows > 250_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], schema=out)
                        held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(*map(np.concatenate, zip(*held, strict=True)))], schema=out)

    return search


def top_k(base: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k base rows of the highest integer inner product with each query."""
    if k < 1:
        raise ValueError("k must be positive")
    one = quantised(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    spark = base.sparkSession
    q = materialise(one.mapInArrow(_packed(QUERY_BLOCK), _BLOCKS), "topk-queries")
    s = materialise(quantised(base, id_col, vec_col, scale).mapInArrow(_packed(SHARD_BLOCK), _BLOCKS), "topk-shards")
    n_q, n_s = q.count(), s.count()
    rows, cols = max(1, -(-n_q // QUERIES_A_TASK)), max(1, min(n_s, LEAST_GROUPS), -(-n_s // SHARDS_A_TASK))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    s = s.select("dim", "n", "ids", "body", at("ids", cols).alias("grp"), every(rows).alias("q_grp"))
    q = q.select("dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("body").alias("q_body"), at("ids", rows).alias("q_grp"), every(cols).alias("grp"))
    tiles = s.join(q.hint("shuffle_hash"), ["grp", "q_grp", "dim"])
    lists = tiles.select("dim", "grp", "n", "ids", "body", "q_n", "q_ids", "q_body").mapInArrow(_searched(k), "query_id long, vec_id long, score long, grp int")
    with small_batches(spark, 4):  # rows of several MB
        lists = materialise(lists, "topk-lists")
    order = [F.col("score").desc(), F.col("vec_id")]
    for level in ([F.col("query_id"), F.col("grp") % max(1, round(cols**0.5))], [F.col("query_id")]):
        w = Window.partitionBy(*level).orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
