"""Difficulty scores, hard-example selection, and isolation of splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


@dataclass(frozen=True)
class Patterns:
    """What counts as number, negation, relation, entity and clause mark in classical Chinese."""

    number: str = r"(?:\p{Nd}+|[〇零一二三四五六七八九十百千万亿两]+(?:年|月|日|人|军|里|丈|尺|亩|岁)|正月|初[一二三四五六七八九十]|[甲乙丙丁戊己庚辛壬癸][子丑寅卯辰巳午未申酉戌亥])"
    negation: str = r"[不未无非莫勿弗毋]|尚未|未尝"
    relation: str = r"故|是以|以故|因|由是|于是|遂|乃|则|虽|然|而|若|苟|盖|既|会"
    entity: str = r"帝|王|后|太子|将军|太守|刺史|尚书|丞相|使者|诏|敕|京|郡|州|县|军"
    clause: str = r"[，；：。！？、]"


def difficulty(source: Column, target: Column, p: Patterns | None = None) -> tuple[Column, Column]:
    """(score, reasons)."""
    p = p or Patterns()
    n = F.greatest(F.length(T.normalize_ws(source)), F.lit(1))
    rules = [
        ("very_long_source", n >= 80, 4),
        ("long_source", (n >= 40) & (n < 80), 2),
        ("expanded_translation", F.length(T.normalize_ws(target)) / n >= 1.45, 2),
        ("date_or_number", source.rlike(p.number), 2),
        ("negation", source.rlike(p.negation), 2),
        ("logical_relation", source.rlike(p.relation), 2),
        ("entity_or_title", source.rlike(p.entity), 1),
        ("multi_clause", F.regexp_count(source, F.lit(p.clause)) >= 4, 2),
    ]
    score = sum((F.when(c, w).otherwise(0) for _, c, w in rules), F.lit(0))
    return score, F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c, _ in rules]))


def annotated(df: DataFrame, bucket: str, score: Column, reasons: Column) -> DataFrame:
    return df.withColumn("selection", F.struct(F.lit(bucket).alias("bucket"), score.alias("score"), reasons.alias("reasons")))


def hard_and_replay(df: DataFrame, score: str, ident: str, source: str, hard: int, replay: int, seed: int | str, names: tuple[str, str] = ("c2m-hard", "c2m-replay")) -> DataFrame:
    """The hardest rows (ties by the stable key of seed, name, id and source), and a hash sample of the others. Adds bucket."""
    key = lambda name: T.stable_key(seed, name, F.col(ident), F.col(source))
    top = df.orderBy(F.col(score).desc(), key(names[0])).limit(hard).withColumn("bucket", F.lit("hard"))
    rest = df.join(top.select(ident), ident, "left_anti").orderBy(key(names[1])).limit(replay).withColumn("bucket", F.lit("replay"))
    return top.unionByName(rest)


def overlaps(df: DataFrame, split: str, key: str) -> DataFrame:
    """Keys that occur in more than one split; grouped once, never joined with itself."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def isolation_report(df: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """(key_kind, overlaps) for each key column."""
    out = None
    for k in keys:
        one = overlaps(df, split, k).agg(F.count("*").alias("overlaps")).select(F.lit(k).alias("key_kind"), "overlaps")
        out = one if out is None else out.unionByName(one)
    return out


def leaked(docs: DataFrame, gold: DataFrame, doc_text: str, gold_text: str) -> DataFrame:
    """Rows of docs whose text (letters and digits) equals a gold text."""
    sig = lambda c: F.sha2(T.content_core(F.col(c)), 256)
    g = gold.select(sig(gold_text).alias("__sig")).distinct()
    return docs.withColumn("__sig", sig(doc_text)).join(g, "__sig", "left_semi").drop("__sig")
