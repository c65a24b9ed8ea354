"""Preference data: candidate triage, the best candidate of each record, routing, caps and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import metrics
from millrace.functions import text as T
from millrace.operators.quality import first_of_key


def distinct_candidates(df: DataFrame, key: str, candidates: str) -> DataFrame:
    """(key, pos, candidate): blank ones dropped, the first of equal ones (white space apart) kept."""
    rows = df.select(key, F.posexplode(candidates).alias("pos", "candidate")).withColumn("__n", T.normalize_join(F.col("candidate"))).where("__n <> ''")
    return first_of_key(rows, [key, "__n"], ["pos"]).drop("__n")


def candidate_reasons(task: Column, source: Column, candidate: Column, reference: Column, repetition: bool = True) -> tuple[Column, Column]:
    """(auto reasons, review flags) of a candidate answer."""
    is_p = F.coalesce(task == "punctuate", F.lit(False))
    core_s, core_c, core_r = T.text_core(source), T.text_core(candidate), T.text_core(reference)
    ratio = T.length_ratio(candidate, reference)
    changed = is_p & (core_s != "") & (core_r != core_s)
    auto = [("empty_output", T.normalize_ws(candidate) == ""), ("format_or_refusal_leak", T.format_leak(candidate))]
    auto += [("adjacent_repetition", T.adjacent_repetition(candidate))] if repetition else []
    auto += [("punctuation_text_changed", is_p & (core_s != "") & ~changed & (core_c != core_s))]
    flags = [
        ("reference_text_changed", changed),
        ("source_echo_without_translation", F.coalesce(task == "c2m", F.lit(False)) & (core_s != "") & (core_c == core_s)),
        ("severe_omission", ~is_p & (ratio < 0.30)),
        ("severe_expansion", ~is_p & (ratio > 2.75)),
    ]
    pack = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return pack(auto), pack(flags)


def numeric_mismatch(source: Column, candidate: Column, reference: Column) -> Column:
    s, c, r = (T.number_set(x, T.SELECT_NUMBER) for x in (source, candidate, reference))
    return (F.size(s) > 0) & (r == s) & (c != r)


def candidate_priority(f1: Column, ratio: Column, mismatch: Column, auto: Column, flags: Column) -> Column:
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    total = F.greatest(0.75 - f1, F.lit(0.0)) * 4.0 + F.abs(1.0 - F.least(ratio, F.lit(2.0))) + one(mismatch, 1.5) + one(F.size(auto) > 0, 2.0) + one(F.size(flags) > 0, 1.0)
    return F.round(total, 6)


def best_candidate(df: DataFrame, key: str, priority: str = "priority", pos: str = "pos") -> DataFrame:
    """One row a record: the highest priority, the first of equals."""
    return first_of_key(df, [key], [F.col(priority).desc(), F.col(pos)])


def routed(records: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """Adds status: approved (automatic reasons), manual, or skipped (no usable candidate)."""
    j = records.join(best, key, "left")
    return j.withColumn("status", F.when(F.col("priority").isNull(), "skipped").when(F.size("auto_reasons") > 0, "approved").otherwise("manual"))


def selected(records: DataFrame, key: str = "id") -> DataFrame:
    """Adds to records (key, task, source_text, reference, candidate_outputs) the candidate that is worst for its reference
    as rejected, its auto_reasons, review_flags and priority, and status: approved, manual, or skipped with a
    selection_reason (no_candidates, all_candidates_equivalent_to_reference). Keys must be unique."""
    told = records.select(key, "task", "source_text", T.strip(F.coalesce("reference", F.lit(""))).alias("reference"))
    usable = distinct_candidates(records, key, "candidate_outputs").join(told, key).where(T.normalize_join(F.col("candidate")) != T.normalize_join(F.col("reference")))
    usable = usable.withColumns({"candidate": T.strip(F.col("candidate")), "__row": F.struct(key, "pos")})
    f1 = metrics.char_scores(usable, "__row", "candidate", "reference").select("__row", "char_f1")
    auto, flags = candidate_reasons(F.col("task"), F.col("source_text"), F.col("candidate"), F.col("reference"))
    rated = usable.join(f1, "__row").withColumns({"auto_reasons": auto, "review_flags": flags})
    moved = numeric_mismatch(F.col("source_text"), F.col("candidate"), F.col("reference"))
    rated = rated.withColumn("priority", candidate_priority(F.col("char_f1"), T.length_ratio(F.col("candidate"), F.col("reference")), moved, F.col("auto_reasons"), F.col("review_flags")))
    best = best_candidate(rated, key).select(key, F.col("candidate").alias("rejected"), "auto_reasons", "review_flags", "priority")
    none = F.coalesce(F.size("candidate_outputs"), F.lit(0)) <= 0
    reason = F.when(F.col("status") == "skipped", F.when(none, "no_candidates").otherwise("all_candidates_equivalent_to_reference"))
    return routed(records, best, key).withColumn("selection_reason", reason)


def selection_counts(chosen: DataFrame) -> DataFrame:
    """(name, n): approved, manual, each reason to skip, reason:<auto reason> of approved rows, review_flag:<flag> of manual ones."""
    named = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    names = (
        F.when(F.col("status") == "approved", F.concat(F.array(F.lit("approved")), named("reason:", F.col("auto_reasons"))))
        .when(F.col("status") == "manual", F.concat(F.array(F.lit("manual")), named("review_flag:", F.col("review_flags"))))
        .otherwise(F.array("selection_reason"))
    )
    return chosen.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def top_per_task(manual: DataFrame, tasks: tuple[str, ...], n: int, key: str = "id", priority: str = "priority") -> DataFrame:
    """At most n rows of each task, the highest priority first, in the order of priority over all."""
    w = Window.partitionBy("task").orderBy(F.col(priority).desc(), key)
    return manual.where(F.col("task").isin(*tasks)).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn").orderBy(F.col(priority).desc(), key)


def generation_queue(records: DataFrame, paired: DataFrame, per_task: int, task: str, key: str, seed: str) -> DataFrame:
    """Records that have no pair yet, at most per_task of each task, in hash order."""
    w = Window.partitionBy(task).orderBy(T.hash_key(seed, F.col(key).cast("string")), key)
    return records.join(paired.select(key), key, "left_anti").withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_task).drop("__rn")


def length_filter(df: DataFrame, prompt: Column, chosen: str, rejected: str, most: int) -> DataFrame:
    n = lambda c: F.length(F.concat(prompt, F.col(c)))
    return df.where((n(chosen) > 0) & (n(chosen) <= most) & (n(rejected) > 0) & (n(rejected) <= most))


def token_length_filter(df: DataFrame, chosen_ids: str, rejected_ids: str, most: int) -> DataFrame:
    ok = lambda c: F.size(c).between(1, most)
    return df.where(ok(chosen_ids) & ok(rejected_ids))


def has_target(labels: Column, ignore: int = -100) -> Column:
    return F.exists(labels, lambda x: x != ignore)
