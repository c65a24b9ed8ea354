"""Constraints: each rule gives a table (rule, detail) of violations; ``require`` runs them all in one action."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def _named(df: DataFrame, rule: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def unique_ids(df: DataFrame, key: str = "id") -> DataFrame:
    k = F.col(key).cast("string")
    bad = df.groupBy(k.alias("k")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("k").isNull() | (T.strip(F.col("k")) == ""))
    return _named(bad, "unique_ids", F.col("k"))


def source_isolation(df: DataFrame, source: str = "source", split: str = "split") -> DataFrame:
    bad = df.groupBy(source).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b")
    return _named(bad, "source_isolation", F.col(source))


def all_found(ids: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    return _named(ids.join(records, key, "left_anti"), "all_found", F.col(key))


def gold_only_in_test(gold: DataFrame, records: DataFrame, key: str = "id", split: str = "split") -> DataFrame:
    missing = _named(gold.join(records, key, "left_anti"), "gold_missing", F.col(key))
    return missing.unionByName(_named(records.where(F.col(split) != "test").join(gold, key, "left_semi"), "gold_outside_test", F.col(key)))


def task_sets(df: DataFrame, tasks: tuple[str, ...], task: str = "task", split: str = "split", source: str = "source") -> DataFrame:
    bad = df.groupBy(split).agg(F.array_sort(F.collect_set(task)).alias("t")).where(F.col("t") != F.array(*[F.lit(x) for x in sorted(tasks)]))
    blank = df.where(F.coalesce(T.strip(F.col(source)), F.lit("")) == "")
    return _named(bad, "task_sets", F.col(split)).unionByName(_named(blank, "blank_source", F.col(task)))


def flags_approved(flagged: DataFrame, approved: DataFrame, key: str = "id") -> DataFrame:
    return _named(flagged.join(approved, key, "left_anti"), "flags_approved", F.col(key))


def one_value(df: DataFrame, column: str) -> DataFrame:
    return _named(df.agg(F.count_distinct(column).alias("n")).where("n > 1"), "one_value", F.lit(column))


def require(*violations: DataFrame) -> None:
    found = reduce(DataFrame.unionByName, violations).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['detail']}" for r in found))


def task_rows(df: DataFrame, value: str, task: str = "task") -> DataFrame:
    """The rows of one task; an error if there are none (looks for one row)."""
    rows = df.where(F.coalesce(F.col(task).cast("string"), F.lit("")) == value)
    if rows.isEmpty():
        raise ValueError(f"no rows of task {value}")
    return rows


def prompts_within(df: DataFrame, prompt: str, most: int | None = None) -> DataFrame:
    """Rows whose prompt is not blank and, if a limit is given, not longer (characters)."""
    n = F.length(prompt)
    return df.where((T.strip(F.coalesce(F.col(prompt), F.lit(""))) != "") & ((n <= most) if most else F.lit(True)))
