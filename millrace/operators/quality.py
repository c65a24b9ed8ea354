"""Cleaning by first failing rule, and audits that collect every flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

TASKS = ("c2m", "m2c", "punctuate")
MIN_DENSITY = 0.05


def punctuation_reason(source: Column, output: Column) -> Column:
    """First failing rule of a punctuated output, or null. Lengths are those of the normalised texts."""
    a, b = T.normalize_content(source), T.normalize_content(output)
    long_ = F.length(a) >= 20
    return (
        F.when((a != "") & (b != "") & (a != b), "punctuation_text_mismatch")
        .when(long_ & (T.punctuation_density(output, b) < MIN_DENSITY), "insufficient_punctuation")
        .when(long_ & ~T.has_boundary(output), "missing_sentence_boundary_punctuation")
        .when(~T.quotes_balanced(output), "unbalanced_quotes")
        .when(T.leads_with_boundary(output, source), "leading_boundary_punctuation")
    )


def clean_reason(task: Column, source: Column, output: Column, has_box: Column, least: int = 4, most: int = 500, tasks: tuple[str, ...] = TASKS, instruction: Column | None = None, keep_box: bool = False) -> Column:
    """unsupported_task, has_box (unless kept), missing_text, input_too_short, input_too_long, a punctuation reason, or
    accepted. Texts are judged without white space at their ends; the instruction must not be blank, if given."""
    task, source, output = (T.strip(F.coalesce(c, F.lit(""))) for c in (task, source, output))
    n = F.length(source)
    missing = (source == "") | (output == "")
    if instruction is not None:
        missing = missing | (T.strip(F.coalesce(instruction, F.lit(""))) == "")
    return (
        F.when(~task.isin(*tasks), "unsupported_task")
        .when(F.lit(not keep_box) & T.truthy(has_box), "has_box")
        .when(missing, "missing_text")
        .when(n < least, "input_too_short")
        .when((n > most) if most > 0 else F.lit(False), "input_too_long")
        .otherwise(F.coalesce(F.when(task == "punctuate", punctuation_reason(source, output)), F.lit("accepted")))
    )


def audit_flags(task: Column, source: Column, output: Column) -> Column:
    """Array of every flag that a pair earns, in the rules' order."""
    a, b = F.coalesce(source, F.lit("")), F.coalesce(output, F.lit(""))
    na, nb = T.normalize_audit(a), T.normalize_audit(b)
    la, lb = F.length(na), F.length(nb)
    is_p = F.coalesce(task == "punctuate", F.lit(False))
    ratio = lb / F.greatest(la, F.lit(1))
    cjk = lambda x: F.array_except(F.array_distinct(T.cjk_characters(x)), F.array(*[F.lit(c) for c in T.COMMON_CHARACTERS]))
    num_a, num_b = T.number_set(a, T.AUDIT_NUMBER), T.number_set(b, T.AUDIT_NUMBER)
    long_p = is_p & (la >= 20)
    rules = [
        ("missing_pair", (T.strip(a) == "") | (T.strip(b) == "")),
        ("identical_input_output", ~is_p & (la > 0) & (na == nb)),
        ("punctuation_text_mismatch", is_p & (la > 0) & (lb > 0) & (na != nb)),
        ("insufficient_punctuation", long_p & (T.punctuation_density(b, nb) < MIN_DENSITY)),
        ("missing_sentence_boundary_punctuation", long_p & ~T.has_boundary(b)),
        ("unbalanced_quotes", is_p & ~T.quotes_balanced(b)),
        ("leading_boundary_punctuation", is_p & T.leads_with_boundary(b, a)),
        ("output_too_short", lb < 2),
        ("extreme_length_ratio", (la >= 8) & ((ratio < 0.20) | (ratio > 4.0))),
        ("low_cjk_output", F.size(T.cjk_characters(b)) < 2),
        ("low_character_overlap", (F.size(cjk(a)) >= 6) & (F.size(cjk(b)) >= 6) & (T.cjk_jaccard(a, b) < 0.05)),
        ("number_or_date_mismatch", (F.size(num_a) > 0) & ~F.arrays_overlap(num_a, num_b)),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def conflicting(df: DataFrame, prompt: str, output: str) -> DataFrame:
    """Adds conflicting: the same normalised prompt has another output in some row."""
    keyed = df.withColumns({"__p": T.normalize_audit(F.col(prompt)), "__o": T.normalize_audit(F.col(output))})
    several = keyed.groupBy("__p").agg((F.min("__o") != F.max("__o")).alias("conflicting"))
    return keyed.join(several, "__p", "left").drop("__p", "__o")


def flag_rates(df: DataFrame, task: str, flags: str) -> DataFrame:
    """Rows, flagged rows and their rate per task and over all (task null)."""
    return df.rollup(task).agg(F.count("*").alias("n"), F.count_if(F.size(flags) > 0).alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("n"), 6))


def without_flags(df: DataFrame, flags: str, removable: list[str], protected: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Drops rows with a removable flag; raises (when run) if such a row's id is protected."""
    hit = F.arrays_overlap(F.col(flags), F.array(*[F.lit(x) for x in removable]))
    if protected is not None:
        guard = protected.select(F.col(key).alias("__g")).distinct()
        df = df.join(guard, F.col(key) == F.col("__g"), "left")
        hit = F.when(hit & F.col("__g").isNotNull(), F.raise_error(F.concat(F.lit("protected id would be removed: "), F.col(key).cast("string"))).cast("boolean")).otherwise(hit)
        return df.where(~F.coalesce(hit, F.lit(False))).drop("__g")
    return df.where(~F.coalesce(hit, F.lit(False)))


def removed_by_flag(df: DataFrame, flags: str, removable: list[str]) -> DataFrame:
    """(flag, n): how many rows each removable flag takes away; a row counts once for each of its removable flags."""
    hit = F.array_intersect(F.col(flags), F.array(*[F.lit(x) for x in removable]))
    return df.select(F.explode(hit).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def valid_conversation(conv: Column) -> Column:
    """Has turns, each with a known role and a value."""
    return F.coalesce((F.size(conv) > 0) & F.forall(conv, lambda t: t["from"].isin("system", "human", "gpt") & t["value"].isNotNull()), F.lit(False))


def grpo_reason(task: Column, source: Column, answer: Column, least: int = 8, most: int = 500) -> Column:
    n = F.length(T.normalize_ws(source))
    return (
        F.when(~F.coalesce(task == "punctuate", F.lit(False)), "not_punctuation")
        .when((T.normalize_ws(source) == "") | (T.normalize_ws(answer) == ""), "empty_text")
        .when(n < least, "source_too_short")
        .when(n > most, "source_too_long")
        .when(T.content_core(source) != T.content_core(answer), "reference_changes_source")
        .otherwise("accepted")
    )


def first_of_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (ties must be broken by the order)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
