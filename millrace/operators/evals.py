"""Evaluation: matching predictions to references, metrics, model comparison and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import metrics
from millrace.functions import text as T

EPSILON = 1e-12


def first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that the table has."""
    for n in names:
        if n in df.columns:
            return F.coalesce(F.col(n).cast("string"), F.lit(""))
    raise ValueError(f"none of {names}")


def occurrence(df: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """Adds __key and __occ, the number of the row among those with its key, in order."""
    return df.withColumn("__key", key).withColumn("__occ", F.row_number().over(Window.partitionBy("__key").orderBy(ordinal)))


def fifo_join(references: DataFrame, predictions: DataFrame, ref_input: str, pred_input: str, ordinal: str = "ordinal", how: str = "inner") -> DataFrame:
    """The i-th reference of an input meets the i-th prediction of it (white space apart)."""
    a = occurrence(references, T.normalize_ws(F.col(ref_input)), ordinal)
    b = occurrence(predictions, T.normalize_ws(F.col(pred_input)), ordinal).drop(ordinal, *([pred_input] if pred_input == ref_input else []))
    return a.join(b, ["__key", "__occ"], how).drop("__key", "__occ")


def fifo_join3(references: DataFrame, baseline: DataFrame, candidate: DataFrame, column: str, strict: bool = True, ordinal: str = "ordinal") -> DataFrame:
    """References with both models' outputs (baseline_output, candidate_output). Strict: a missing one is an error."""
    key = T.normalize_ws(F.col(column))
    side = lambda df, name: occurrence(df, key, ordinal).select("__key", "__occ", F.col("output").alias(name))
    j = occurrence(references, key, ordinal).join(side(baseline, "baseline_output"), ["__key", "__occ"], "left").join(side(candidate, "candidate_output"), ["__key", "__occ"], "left")
    whole = F.col("baseline_output").isNotNull() & F.col("candidate_output").isNotNull()
    if strict:
        whole = F.when(whole, True).otherwise(F.raise_error(F.lit("a prediction is missing")).cast("boolean"))
    return j.where(whole).drop("__key", "__occ")


def zip_join(queue: DataFrame, predictions: DataFrame, column: str, ordinal: str = "ordinal") -> DataFrame:
    """Row i of one with row i of the other; a length or prompt that differs is an error."""
    b = predictions.select(ordinal, F.col(column).alias("__p"), F.col("output").alias("prediction"))
    j = queue.join(b, ordinal, "full_outer")
    same = T.normalize_join(F.col(column)) == T.normalize_join(F.col("__p"))
    ok = F.when(F.coalesce(same, F.lit(False)), True).otherwise(F.raise_error(F.lit("rows do not line up")).cast("boolean"))
    return j.where(ok).drop("__p")


def task_means(df: DataFrame, task: str, *columns: str) -> DataFrame:
    """Rows and means per task and over all (task null)."""
    return df.rollup(task).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in columns])


def compared(df: DataFrame, baseline: str, candidate: str) -> DataFrame:
    d = F.col(candidate) - F.col(baseline)
    return df.withColumn("outcome", F.when(d > EPSILON, "win").when(d < -EPSILON, "loss").otherwise("tie")).withColumn("delta", d)


def outcomes(df: DataFrame, task: str) -> DataFrame:
    one = lambda x: F.count_if(F.col("outcome") == x)
    return df.rollup(task).agg(F.count("*").alias("n"), one("win").alias("wins"), one("tie").alias("ties"), one("loss").alias("losses"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def model_sections(df: DataFrame, task: str, models: tuple[str, str] = ("baseline", "candidate")) -> DataFrame:
    """One row per task and one over all (task null) of <model>_exact, _f1, _length_ratio and _output: means, empty outputs
    and tag leaks of both models, the second's differences, and its wins, ties and losses in f1."""
    a, b = models
    d = F.col(f"{b}_f1") - F.col(f"{a}_f1")
    of = lambda m: [
        F.avg(f"{m}_exact").alias(f"{m}_exact"), F.avg(f"{m}_f1").alias(f"{m}_f1"), F.avg(f"{m}_length_ratio").alias(f"{m}_length_ratio"),
        F.count_if(T.normalize_ws(F.col(f"{m}_output")) == "").alias(f"{m}_empty"), F.count_if(T.tag_leak(F.col(f"{m}_output"))).alias(f"{m}_leaks"),
    ]
    won = [F.count_if(d > EPSILON).alias("wins"), F.count_if(F.abs(d) <= EPSILON).alias("ties"), F.count_if(d < -EPSILON).alias("losses")]
    means = df.rollup(task).agg(F.count("*").alias("n"), *of(a), *of(b), *won)
    rounded = {f"{m}_{c}": F.round(f"{m}_{c}", 6) for m in models for c in ("exact", "f1", "length_ratio")}
    return means.withColumns({f"{c}_delta": F.round(F.col(f"{b}_{c}") - F.col(f"{a}_{c}"), 6) for c in ("exact", "f1", "length_ratio")}).withColumns(rounded)


def punctuation_means(df: DataFrame, *columns: str, preserved: str = "text_preserved") -> DataFrame:
    """One row: the number of rows, the mean of each column and of ``preserved``, and how many texts are preserved."""
    kept = F.coalesce(F.col(preserved).cast("int"), F.lit(0))
    return df.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in columns], F.round(F.avg(kept), 6).alias(preserved), F.coalesce(F.sum(kept), F.lit(0)).alias(f"{preserved}_count"))


def comparison_flags(delta: Column, candidate_flags: Column, baseline_flags: Column, margin: float = 0.05) -> Column:
    """regression or improvement beyond the margin, then new_<flag> for each flag that only the candidate has."""
    moved = F.array_compact(F.array(F.when(delta < -margin, "regression").when(delta > margin, "improvement")))
    new = F.array_sort(F.array_except(candidate_flags, baseline_flags))
    return F.concat(moved, F.transform(new, lambda x: F.concat(F.lit("new_"), x)))


def triage_summary(df: DataFrame, task: str, baseline_flags: str, candidate_flags: str, delta: str) -> DataFrame:
    """(task, model, flag, n): rows (model and flag 'rows'), each model's flags, and the comparison's flags."""
    said = lambda name, c: F.transform(c, lambda x: F.struct(F.lit(name).alias("model"), x.alias("flag")))
    versus = comparison_flags(F.col(delta), F.col(candidate_flags), F.col(baseline_flags))
    each = F.concat(said("rows", F.array(F.lit("rows"))), said("baseline", F.col(baseline_flags)), said("candidate", F.col(candidate_flags)), said("comparison", versus))
    return df.select(task, F.explode(each).alias("e")).groupBy(task, F.col("e.model").alias("model"), F.col("e.flag").alias("flag")).agg(F.count("*").alias("n"))


def triage_flags(task: Column, source: Column, output: Column, reference: Column, f1: Column) -> Column:
    ratio = T.length_ratio(output, reference)
    is_p = F.coalesce(task == "punctuate", F.lit(False))
    core_o, core_s = T.content_core(output), T.content_core(source)
    wanted = T.numbers(reference, T.TRIAGE_NUMBER)
    rules = [
        ("empty_output", T.normalize_ws(output) == ""),
        ("punctuation_text_changed", is_p & (core_o != core_s)),
        ("source_echo", ~is_p & (core_s != "") & (core_o == core_s)),
        ("omission_risk", ~is_p & (ratio < 0.65)),
        ("over_translation_risk", ~is_p & (ratio > 1.55)),
        ("low_reference_overlap", ~is_p & (f1 < 0.40)),
        ("number_or_date_mismatch_risk", ~is_p & (F.size(wanted) > 0) & (T.numbers(output, T.TRIAGE_NUMBER) != wanted)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def triage_priority(delta: Column, candidate_flags: Column, baseline_flags: Column) -> Column:
    has = lambda n, w: F.when(F.array_contains(candidate_flags, n), w).otherwise(0.0)
    differ = F.when(F.array_sort(candidate_flags) != F.array_sort(baseline_flags), 0.5).otherwise(0.0)
    return 8 * F.greatest(-delta, F.lit(0.0)) + has("source_echo", 3.0) + has("punctuation_text_changed", 2.5) + has("omission_risk", 2.0) + has("low_reference_overlap", 1.5) + has("number_or_date_mismatch_risk", 1.0) + differ


def review_queue(df: DataFrame, n: int, priority: str = "priority", delta: str = "delta", ordinal: str = "ordinal") -> DataFrame:
    """The n rows of the highest priority, larger losses first; adds review_rank."""
    top = df.orderBy(F.col(priority).desc(), F.col(delta), ordinal).limit(n)
    return top.withColumn("review_rank", F.row_number().over(Window.orderBy(F.col(priority).desc(), F.col(delta), ordinal)))


def length_summary(df: DataFrame, group: str, length: Column, limit: int) -> DataFrame:
    """Nearest-rank percentiles, extremes and the share over a limit."""
    x = df.select(group, length.alias("x"))
    q = [F.expr(f"percentile_disc({p}) within group (order by x)").cast("long").alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return x.groupBy(group).agg(F.count("*").alias("n"), F.min("x").cast("long").alias("least"), *q, F.max("x").cast("long").alias("most"), F.count_if(F.col("x") > limit).alias("over"))


def perplexity(df: DataFrame, nll: str, length: str, chars: str) -> DataFrame:
    return df.agg(F.exp(F.sum(F.col(nll) * F.col(length)) / (F.count("*") * F.sum(chars))).alias("perplexity"))


def macro_perplexity(loss: Column) -> Column:
    return F.when(loss > 709, F.lit(float("inf"))).otherwise(F.exp(loss))


def token_accuracy(df: DataFrame, predicted: str, labels: str, ignore: int = -100) -> DataFrame:
    """Share of right tokens, predictions shifted by one, ignored labels apart."""
    pairs = df.select(F.explode(F.arrays_zip(F.slice(predicted, 1, F.size(predicted) - 1).alias("p"), F.slice(labels, 2, F.size(labels)).alias("l"))).alias("z"))
    return pairs.where(F.col("z.l") != ignore).agg(F.avg((F.col("z.p") == F.col("z.l")).cast("double")).alias("accuracy"))


def reward_errors(df: DataFrame, predicted: str, target: str) -> DataFrame:
    d = F.col(predicted) - F.col(target)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def pairwise_loss(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return df.agg(F.avg(F.log1p(F.exp(-(F.col(chosen) - F.col(rejected))))).alias("loss"))


def bootstrap_interval(df: DataFrame, key: str, delta: str, rounds: int = 1000, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean of paired differences; Poisson weights from hashes, so reruns agree."""
    u = F.pmod(F.xxhash64(F.col(key), F.col("round")), F.lit(1 << 30)) / float(1 << 30)
    steps = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    means = df.select(key, delta, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight).groupBy("round").agg((F.sum(F.col("w") * F.col(delta)) / F.sum("w")).alias("m"))
    a = (1 - level) / 2
    return means.agg(F.expr(f"percentile(m, {a})").alias("low"), F.expr(f"percentile(m, {1 - a})").alias("high"))


def scored(df: DataFrame, key: str, output: str, reference: str) -> DataFrame:
    """Adds char_*, boundary_* and position_* scores, length_ratio and exact."""
    out = df.withColumns({"length_ratio": T.length_ratio(F.col(output), F.col(reference)), "exact": T.exact_match(F.col(output), F.col(reference)).cast("double")})
    for m in (metrics.char_scores(df, key, output, reference), metrics.boundary_scores(df, key, output, reference), metrics.boundary_scores(df, key, output, reference, typed=False)):
        out = out.join(m, key)
    return out
