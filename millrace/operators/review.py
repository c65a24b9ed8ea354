"""Human review: candidates, decisions and their application; every rule that fails names its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import convo

APPROVED = ("approved", "accepted", "ready")
STATUSES, CONFIDENCES = ("approved", "rejected"), ("high", "medium", "low")


def pending(df: DataFrame) -> DataFrame:
    return df.withColumns({"review_status": F.lit("pending"), "approved_reference": F.lit(""), "review_notes": F.lit("")})


def is_approved(status: Column) -> Column:
    return F.coalesce(F.lower(T.strip(status)).isin(*APPROVED), F.lit(False))


def final_reference(approved: Column, reference: Column) -> Column:
    return F.coalesce(F.nullif(T.strip(approved), F.lit("")), reference)


def merge_problems(candidates: DataFrame, reviews: DataFrame, flags: bool = False) -> DataFrame:
    """(id, problem) of a merge that must be complete both ways; empty if all is well."""
    one = lambda df, side: df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(f"duplicate_{side}").alias("problem"))
    c, r = candidates.alias("c"), reviews.alias("r")
    j = c.join(r, F.col("c.id") == F.col("r.id"), "full_outer")
    rule = (
        F.when(F.col("c.id").isNull(), "unknown_id")
        .when(F.col("r.id").isNull(), "missing_review")
        .when(~F.col("c.task").eqNullSafe(F.col("r.task")), "task_mismatch")
        .when(~F.coalesce(F.col("r.review_status").isin(*STATUSES), F.lit(False)), "illegal_status")
        .when(~F.coalesce(F.col("r.confidence").isin(*CONFIDENCES), F.lit(False)), "illegal_confidence")
        .when(F.coalesce(T.strip(F.col("r.review_notes")), F.lit("")) == "", "blank_notes")
    )
    if flags:
        same = F.array_sort(F.array_distinct("c.audit_flags")).eqNullSafe(F.array_sort(F.array_distinct("r.audit_flags")))
        rule = F.coalesce(rule, F.when(~same, "flags_differ"))
    found = j.select(F.coalesce("c.id", "r.id").alias("id"), rule.alias("problem")).where("problem IS NOT NULL")
    return found.unionByName(one(candidates, "candidate")).unionByName(one(reviews, "review"))


def merged(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """The approved benchmark: final and original reference, whether corrected, reviewer and confidence."""
    r = reviews.select("id", "review_status", "confidence", "approved_reference", F.col("review_notes").alias("notes"), "reviewer")
    c = candidates.drop("review_status", "approved_reference", "review_notes")
    j = c.join(r, "id").where(F.col("review_status") == "approved")
    final = final_reference(F.col("approved_reference"), F.col("reference"))
    return j.select(
        "id", "task", "source", "category", "prompt", final.alias("reference"), F.col("reference").alias("original_reference"),
        (final != F.col("reference")).alias("reference_corrected"), "reviewer", F.col("confidence").alias("review_confidence"), F.col("notes").alias("review_notes"),
    )


def high_confidence(df: DataFrame) -> DataFrame:
    return df.where(F.col("review_confidence") == "high")


def apply_reviews(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rejected records go; approved ones with a reference get it as their answer; others stay. Adds review_action.

    Raises (when run) if a reviewed id repeats, has not one assistant message, or answers otherwise than the text that
    was reviewed (``reference`` of the reviews, where they have it)."""
    seen = F.nullif(T.strip(F.col("reference")), F.lit("")) if "reference" in reviews.columns else F.lit(None).cast("string")
    r = reviews.select("id", F.col("review_status").alias("__st"), F.nullif(T.strip(F.col("approved_reference")), F.lit("")).alias("__ref"), seen.alias("__seen"))
    many = F.count("*").over(Window.partitionBy("id"))
    j = records.join(r, "id", "left").withColumn("__n", many)
    answers = F.filter("conversations", lambda t: t["from"].isin(*convo.ASSISTANT))
    problem = (
        F.when(F.col("__n") > 1, "the id repeats")
        .when(F.size(answers) != 1, "there is not one assistant message")
        .when(F.col("__seen") != convo.last_of(F.col("conversations"), convo.ASSISTANT), "the answer is not the reviewed one")
    )
    wrong = F.col("__st").isNotNull() & problem.isNotNull()
    status = F.when(wrong, F.raise_error(F.concat(F.col("id").cast("string"), F.lit(": "), problem)).cast("string")).otherwise(F.col("__st"))
    action = F.when(status == "rejected", "removed").when((status == "approved") & F.col("__ref").isNotNull(), "corrected").when(status.isNotNull(), "confirmed").otherwise("unreviewed")
    conv = F.when(F.col("review_action") == "corrected", convo.replace_assistant(F.col("conversations"), F.col("__ref"))).otherwise(F.col("conversations"))
    return j.withColumn("review_action", action).withColumn("conversations", conv).drop("__st", "__ref", "__seen", "__n")


def finalized(records: DataFrame, flagged: DataFrame, approved: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): flagged ids that are not approved go."""
    gone = flagged.select(key).distinct().join(approved.select(key).distinct(), key, "left_anti")
    return records.join(gone, key, "left_anti"), records.join(gone, key, "left_semi")


REMOVAL = "unreviewed audit risk removed by conservative V5 finalization policy"  # fixed value of the logs


def removal_log(removed: DataFrame, audits: DataFrame, split: str, reason: str = REMOVAL) -> DataFrame:
    """(id, task, source, split, audit_flags, removal_reason) of removed records; no flags if their audit is absent."""
    flags = audits.select(F.col("id").alias("__aid"), "audit_flags").dropDuplicates(["__aid"])
    j = removed.drop("audit_flags").join(flags, F.col("id") == F.col("__aid"), "left")
    none = F.array().cast("array<string>")
    return j.select("id", "task", "source", F.lit(split).alias("split"), F.coalesce("audit_flags", none).alias("audit_flags"), F.lit(reason).alias("removal_reason"))


def correction_pairs(corrections: DataFrame, training: DataFrame, split: str = "train", ordinal: str = "ordinal") -> DataFrame:
    """Adds reason to corrections: the first failing rule, or accepted. An id is used up by its first success; every
    later correction of it is a duplicate, whatever else it fails. Raises (when run) if a training id repeats."""
    t = training.groupBy(F.col("id").alias("__tid")).agg(F.count("*").alias("__n"))
    j = corrections.join(t, F.col("id") == F.col("__tid"), "left")
    known = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated training id: "), F.col("__tid").cast("string"))).cast("boolean")).otherwise(F.col("__tid").isNotNull())
    a, o = T.normalize_join(F.col("approved_reference")), T.normalize_join(F.col("original_reference"))
    reason = (
        F.when(F.coalesce(T.strip(F.col("id").cast("string")), F.lit("")) == "", "missing_or_duplicate_id")
        .when(F.coalesce(F.col("split"), F.lit(split)) != split, "not_training_split")
        .when(F.coalesce(F.lower("confidence"), F.lit("")) != "high", "not_high_confidence")
        .when(~known, "id_not_found_in_training")
        .when((a == "") | (o == "") | (a == o), "empty_or_identical_pair")
        .otherwise("accepted")
    )
    first = F.min(F.when(F.col("reason") == "accepted", F.col(ordinal))).over(Window.partitionBy("id"))
    j = j.withColumn("reason", reason).withColumn("__first", first)
    return j.withColumn("reason", F.when(F.col(ordinal) > F.col("__first"), "missing_or_duplicate_id").otherwise(F.col("reason"))).drop("__tid", "__n", "__first")


def preference_reason(conversations: Column, chosen: Column, rejected: Column) -> Column:
    a, b = T.normalize_join(chosen), T.normalize_join(rejected)
    return (
        F.when(F.coalesce(F.size(conversations), F.lit(0)) <= 0, "missing_conversations")
        .when((a == "") | (b == ""), "missing_preference")
        .when(a == b, "identical_preference")
        .otherwise("accepted")
    )


def nested_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def each_flag(df: DataFrame, flags: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(flags).alias("flag")).groupBy(*keys, "flag").agg(F.count("*").alias("n"))
