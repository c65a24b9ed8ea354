"""Token sequences: truncation and masking of turns, and packing into blocks. The tokenizer is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def encode_turns(pairs: list[tuple[list[int], list[int]]], most: int, eos: int) -> tuple[list[int], list[int]]:
    """ids and labels of (source, target) turns; each turn's share of the room follows its lengths, sources are masked."""
    ids, labels = [], []
    for source, target in pairs:
        total = len(source) + len(target)
        room_s, room_t = (int(most * len(source) / total), int(most * len(target) / total)) if total else (0, 0)
        s, t = source[:room_s] if len(source) > room_s else source, target[: room_t - 1] if len(target) > room_t - 1 else target
        if len(ids) + len(s) + len(t) + 1 > most:
            break
        ids += [*s, *t, eos]
        labels += [IGNORE] * len(s) + [*t, eos]
    return ids, labels


def encoded(df: DataFrame, key: str, pairs: str, tokenize: Callable[[str], list[int]], most: int, eos: int) -> DataFrame:
    """(key, input_ids, labels); ``pairs`` is array<struct<user, assistant>>."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [encode_turns([(tokenize(p["user"]), tokenize(p["assistant"])) for p in row], most, eos) for row in frame[pairs]]
            yield pd.DataFrame({key: frame[key], "input_ids": [x[0] for x in out], "labels": [x[1] for x in out]})

    return df.select(key, pairs).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, input_ids array<int>, labels array<int>")


def packed(df: DataFrame, group: str, order: str, tokens: str | Column, block: int) -> DataFrame:
    """(group, block_no, tokens): all tokens of a group one after another, cut into blocks; the remainder goes
    if there is at least one whole block. Only the numbers of tokens go by group; rows meet their places by (group, order),
    are cut where blocks end, and the slices are joined. Rows that share an order stand one after another by hash.
    Tokens given as an expression are made after rows are dealt, which moves less."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    size = lambda t: F.coalesce(F.size(t), F.lit(0)).cast("long").alias("__n")
    keyed = df.withColumn("__key", F.struct(F.col(group).alias("g"), F.col(order).alias("o")))
    upto = lambda w: F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    sizes = keyed.select("__key", size(tokens)).groupBy("__key").agg(F.sum("__n").alias("__n"))
    g = Window.partitionBy("__key.g")
    places = sizes.select("__key", upto(g.orderBy("__key.o")).alias("__at"), F.sum("__n").over(g).alias("__total"))
    rows = keyed.repartition(F.col("__key")).select("__key", tokens.alias("__t")).select("*", size(F.col("__t")))
    rows = rows.withColumn("__own", upto(Window.partitionBy("__key").orderBy(F.xxhash64("__t")))).join(places, "__key")
    at, end = F.col("__at") + F.col("__own"), F.col("__at") + F.col("__own") + F.col("__n")

    def piece(b: Column) -> Column:
        start = F.greatest(b * block, at)
        return F.struct(b.alias("block_no"), start.alias("pos"), F.slice("__t", (start - at + 1).cast("int"), (F.least((b + 1) * block, end) - start).cast("int")).alias("part"))

    last = F.when(F.col("__total") < block, F.lit(0)).otherwise(F.expr(f"__total div {block} - 1"))
    numbers = F.sequence(F.expr(f"(__at + __own) div {block}"), F.expr(f"(__at + __own + __n - 1) div {block}"))
    pieces = rows.select(F.col("__key.g").alias(group), F.explode_outer(F.when(F.col("__n") > 0, F.transform(F.filter(numbers, lambda b: b <= last), piece))).alias("__p")).where("__p is not null")
    lists = pieces.select(group, "__p.*").repartition(F.col(group), F.col("block_no")).groupBy(group, "block_no").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("__l"))
    return lists.select(group, "block_no", F.flatten(F.transform("__l", lambda x: x["part"])).alias("tokens"))


def padded(ids: Column, most: int, pad: int) -> Column:
    cut = F.slice(ids, 1, most)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(most) - F.size(cut), F.lit(0)).cast("int")))


def inferred(df: DataFrame, column: str, model: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """Adds output: a model over batches of texts; columns, the ordinal among them, stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[column].tolist()
            frame["output"] = [y for i in range(0, len(texts), batch) for y in model(texts[i : i + batch])]
            yield frame

    return df.mapInPandas(run, df.schema.add("output", "string"))
