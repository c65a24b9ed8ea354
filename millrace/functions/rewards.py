"""Verifiable rewards. Similarity and F1 columns are computed first (metrics, sequence_ratio)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions import text as T

# Markers that a direct answer must not hold, and the recipes' weights.
FORBIDDEN = ("<think>", "<answer>", "```", "答案：", "解释：")
RECIPE_V1 = (0.45, 0.35, 0.15, 0.05)
RECIPE_V2 = (0.45, 0.40, 0.15)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts; no built-in has its semantics."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def preservation_v1(output: Column, source: Column) -> Column:
    a, b = T.content_core(output), T.content_core(source)
    return F.when(a == b, 1.0).otherwise(0.5 * sequence_ratio(a, b))


def punctuation_v1(boundary_f1: Column, output: Column, source: Column) -> Column:
    return boundary_f1 * sequence_ratio(T.content_core(output), T.content_core(source))


def exact(output: Column, reference: Column) -> Column:
    return T.exact_match(output, reference).cast("double")


def direct_format(output: Column) -> Column:
    ok = T.strip(output) != ""
    for m in FORBIDDEN:
        ok &= ~F.contains(output, F.lit(m))
    return F.coalesce(ok, F.lit(False)).cast("double")


def preservation_guard(output: Column, source: Column) -> Column:
    return F.when(T.content_core(output) == T.content_core(source), 1.0).otherwise(-1.0)


def gated(f1: Column, output: Column, source: Column) -> Column:
    """A boundary or position F1 that counts only where the text is preserved."""
    return F.when(T.content_core(output) == T.content_core(source), f1).otherwise(0.0)


def recipe(weights: tuple[float, ...], *rewards: Column) -> Column:
    return sum((w * r for w, r in zip(weights, rewards, strict=True)), F.lit(0.0))


def math_accuracy(output: Column, answer: Column) -> Column:
    """1 if the answers' texts, or their numbers, are equal."""
    norm = lambda x: F.lower(T.normalize_join(x))
    a, b = T.think_answer(output), answer
    number = lambda x: F.coalesce(T.final_number(x), F.regexp_replace(F.trim(x), ",", "").try_cast("double"))
    return F.coalesce((norm(a) == norm(b)) | (number(a) == number(b)), F.lit(False)).cast("double")


def completion_text(messages: Column) -> Column:
    return F.coalesce(F.element_at(messages, -1)["content"], F.lit(""))
