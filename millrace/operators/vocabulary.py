"""Vocabularies: pieces of one table that another lacks, and the most frequent words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.quality import first_of_key


def merged(base: DataFrame, *others: DataFrame) -> DataFrame:
    """(piece, score, part, ordinal): the base (part 0) as it is, then of each other table the pieces that no part before
    has, with score 0. Tables hold piece and ordinal, the base a score too; a piece repeated within one other table stands
    once, at its first place. Null pieces of other tables are left out."""
    known = base.select("piece", F.col("score").cast("double").alias("score"), F.lit(0).alias("part"), F.col("ordinal").cast("long").alias("ordinal"))
    if not others:
        return known
    new = None
    for i, t in enumerate(others, 1):
        rows = t.where(F.col("piece").isNotNull()).select("piece", F.lit(0.0).alias("score"), F.lit(i).alias("part"), F.col("ordinal").cast("long").alias("ordinal"))
        new = rows if new is None else new.unionByName(rows)
    new = first_of_key(new, ["piece"], ["part", "ordinal"]).join(base.select("piece"), "piece", "left_anti")
    return known.unionByName(new)


def most_frequent(words: DataFrame, n: int, word: str = "word", freq: str = "freq", ordinal: str = "ordinal") -> DataFrame:
    """The n most frequent words, the first in the table's order of equals."""
    return words.orderBy(F.col(freq).desc(), ordinal).limit(n)
