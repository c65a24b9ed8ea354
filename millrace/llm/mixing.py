"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a hash of its id in 16 hexadecimal digits. Per source, words are summed
by hash bucket (four digits); the budget's threshold lies in one boundary bucket, whose
documents alone are summed again by the next four digits, and so on to the last. A document
is taken if its hash is below its source's threshold: no document is sorted, and budgets
are nested (a larger target takes a superset).

Defined results: null text has size 0; a null source is a source of its own, last in order.
Documents of size 0 take 0. Rows that repeat an id share its hash: they are taken together
or not at all. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, all_of, materialise, unlike

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = "mix"
DIGITS = 4
LEVELS = 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, DIGITS * LEVELS)


def ranked(sources: DataFrame) -> DataFrame:
    """Adds pos, the place of each source in code-point order, null last, without one task for all.

    Range partitions are numbered inside; what stands before each comes from a table of counts."""
    null_last = [F.col("source").isNull().cast("int"), F.col("source")]
    parts = max(1, min(64, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = materialise(sources.repartitionByRange(parts, *null_last).sortWithinPartitions(*null_last).withColumn("__id", F.monotonically_increasing_id()), "mix-sources")
    placed = placed.withColumns({"__part": F.shiftrightunsigned("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))  # a row a range partition, 64 at most
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return placed.join(F.broadcast(before), "__part").withColumn("pos", F.col("__row") + F.col("__before")).drop("__id", "__part", "__row", "__before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weighted shares of share * all, none above
    repeats * source_size, the excess reshared by weight until none is above."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    placed = materialise(ranked(sources).withColumn("weight", w), "mix-weights")
    total = (placed.agg(F.sum("source_size")).first()[0] or 0) * share
    most = F.col("source_size") * float(repeats)
    level, n_free = 0.0, None
    while True:  # each round caps at least one more source, or ends; a round sends three numbers
        full = (most < F.col("weight") * level) | (F.col("source_size") == 0)
        got = placed.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(~full, 1))).first()
        if not got[1] or got[2] == n_free:
            break
        n_free, level = got[2], (total - (got[0] or 0.0)) / got[1]
    return placed.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(most, F.col("weight") * F.lit(float(level)))).alias("target"))


def _crossed(sums: DataFrame, bucket: str) -> DataFrame:
    """Of each source the bucket in which the sum in bucket order passes rest, with what of rest falls into it."""
    upto = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy(bucket)) - F.col("n"))
    cut = upto.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    return cut.select("source", bucket, (F.col("rest") - F.col("before")).alias("rest"), "n")


def boundary(sums: DataFrame, digits: int) -> DataFrame:
    """(source, prefix, rest, bucket_n) of the boundary buckets of (source, rest, prefix, n).

    First among sums by the first ``digits`` digits, then among the buckets of that lead alone, so that a source has at
    most 256 rows in either window."""
    lead = F.substring("prefix", 1, digits).alias("lead")
    first = _crossed(sums.groupBy("source", "rest", lead).agg(F.sum("n").alias("n")), "lead").select(F.col("source").alias("s"), F.col("lead").alias("l"), "rest")
    inside = sums.drop("rest").join(first, F.col("source").eqNullSafe(F.col("s")) & (F.substring("prefix", 1, digits) == F.col("l"))).drop("s", "l")
    return _crossed(inside, "prefix").withColumnRenamed("n", "bucket_n")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken."""
    slim = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("h")), "mix-sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(sources, weights, share, repeats), "mix-targets")
    # Each document is taken `whole` times; one more time if its hash is below the threshold for the rest.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    edge = goal.select("source", F.lit("").alias("prefix"), "rest")
    for level in range(1, LEVELS + 1):
        # Only the documents of the boundary bucket are summed, by the next digits of their hash.
        inside = slim.withColumn("p0", F.substring("h", 1, DIGITS * (level - 1))).alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.p0") == F.col("e.prefix")))
        sums = inside.groupBy(F.col("d.source").alias("source"), F.col("e.rest").alias("rest"), F.substring("d.h", 1, DIGITS * level).alias("prefix")).agg(F.sum("d.size").alias("n"))
        edge = boundary(materialise(sums, f"mix-sums{level}"), DIGITS * level - DIGITS // 2)
        edge = materialise(edge, f"mix-edge{level}")
        last = edge
        edge = edge.select("source", "prefix", "rest")
    # The boundary document itself is taken if that brings the sum nearer.
    cut = last.select(F.col("source").alias("s"), F.col("prefix").alias("cut"), (F.col("rest") * 2 > F.col("bucket_n")).alias("with_cut"))
    goal = goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target", "whole", "rest", "cut", "with_cut")
    out = slim.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    under = (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("with_cut")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + under.cast("long"))).alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken; documents of size 0 take no part.

    A row is known by its id, source and size: rows that agree in all three are taken equally often. Columns of any
    name are kept."""
    times = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col).where(F.col("taken") > 0)
    i, s, n, k = unlike(docs, "__id", "__source", "__size", "__times")
    times = times.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), (F.col("taken") / F.col("size")).cast("int").alias(k)).distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & F.col(f"`{source_col}`").eqNullSafe(F.col(s)) & (size_of(F.col(f"`{text_col}`")) == F.col(n))
    joined = docs.join(times, same)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(k)))).select(*all_of(docs))
