"""Multiset metrics of characters and punctuation boundaries, exploded rather than nested, so long texts
spread over tasks and counts are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def prf(overlap: Column, predicted: Column, wanted: Column) -> tuple[Column, Column, Column]:
    p = F.when(predicted > 0, overlap / predicted).otherwise(0.0)
    r = F.when(wanted > 0, overlap / wanted).otherwise(0.0)
    return p, r, F.when(overlap > 0, 2 * overlap / (predicted + wanted)).otherwise(0.0)


def _scores(df: DataFrame, key: str, predicted: Column, wanted: Column, name: str) -> DataFrame:
    """(key, <name>_p, <name>_r, <name>_f1) of two arrays taken as multisets."""
    slim = df.select(F.col(key), predicted.alias("p"), wanted.alias("w"))
    side = lambda c: slim.select(key, F.explode(c).alias("e")).groupBy(key, "e").agg(F.count("*").alias(f"n_{c}"))
    both = side("p").join(side("w"), [key, "e"], "inner").groupBy(key).agg(F.sum(F.least("n_p", "n_w")).alias("o"))
    sizes = slim.select(key, F.size("p").alias("n_p"), F.size("w").alias("n_w"))
    p, r, f = prf(F.coalesce("o", F.lit(0)), F.col("n_p"), F.col("n_w"))
    return sizes.join(both, key, "left").select(key, p.alias(f"{name}_p"), r.alias(f"{name}_r"), f.alias(f"{name}_f1"))


def char_scores(df: DataFrame, key: str, output: str, reference: str) -> DataFrame:
    """Precision, recall and F1 of characters without white space; an empty side gives 0."""
    return _scores(df, key, T.characters(T.normalize_ws(F.col(output))), T.characters(T.normalize_ws(F.col(reference))), "char")


def boundaries(x: Column, typed: bool = True, marks: str = T.MARKS) -> Column:
    """Keys (content index[, mark]) of the marks in a text; the index is the number of word characters before."""
    x = T.normalize_ws(x)
    mark = T._class(marks)
    sizes = F.transform(F.split(x, mark), lambda part: F.length(F.regexp_replace(part, r"[^\p{L}\p{N}_]", "")))
    found = F.regexp_extract_all(x, F.lit(f"({mark})"), F.lit(1))

    def keys(z: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(z["sizes"], F.lit(1), i + 1), F.lit(0), lambda n, k: n + k).cast("string")
        return F.transform(z["found"], lambda c, i: F.concat_ws("|", before(i), c) if typed else before(i))

    # one struct, so that both arrays are worked out once a text and not once a mark
    return F.transform(F.array(F.struct(sizes.alias("sizes"), found.alias("found"))), keys)[0]


def boundary_scores(df: DataFrame, key: str, output: str, reference: str, typed: bool = True) -> DataFrame:
    name = "boundary" if typed else "position"
    return _scores(df, key, boundaries(F.col(output), typed), boundaries(F.col(reference), typed), name)


def punctuation_error(output: Column, reference: Column) -> Column:
    return F.abs(F.size(boundaries(output)) - F.size(boundaries(reference)))


def text_preserved(output: Column, prompt_body: Column) -> Column:
    return T.content_core(output) == T.content_core(prompt_body)
