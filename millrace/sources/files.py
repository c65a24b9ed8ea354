"""Files in and out: JSON lines in a tolerant and a strict lane, text, tab-separated and JSON arrays."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions import text as T

CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Every line with raw, file and state (blank, invalid_json, non_object, ok), and record where it is ok."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("raw"), F.col("_metadata.file_path").alias("file"))
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    got = raw.withColumn("record", F.from_json("raw", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    ok = F.try_parse_json("raw").isNotNull()
    state = F.when(T.strip(F.col("raw")) == "", "blank").when(~ok, "invalid_json").when(~T.strip(F.col("raw")).startswith("{"), "non_object").otherwise("ok")
    return got.withColumn("state", state)


def tolerant(lines: DataFrame) -> DataFrame:
    """Records of good lines; others are skipped."""
    return lines.where("state = 'ok'").select("record.*").drop(CORRUPT)


def line_stats(lines: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("state") == s).alias(s)
    return lines.agg(F.count("*").alias("raw_lines"), one("blank"), one("invalid_json"), one("non_object"), one("ok"))


def strict(lines: DataFrame) -> DataFrame:
    """Records; the first bad line (blank ones apart) stops the query with its file."""
    bad = F.col("state").isin("invalid_json", "non_object")
    stop = F.when(bad, F.raise_error(F.concat_ws(": ", F.col("state"), F.col("file"), F.substring("raw", 1, 80))).cast("boolean")).otherwise(F.col("state") == "ok")
    return lines.where(stop).select("record.*").drop(CORRUPT)


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Adds ordinal, from 0, in the given order: places of range partitions plus the rows before each."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    part = placed.withColumns({"__p": F.shiftrightunsigned("__id", 33), "__r": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
    counts = part.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.withColumn("__b", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return part.join(F.broadcast(before), "__p").withColumn("ordinal", F.col("__r") + F.col("__b")).drop("__p", "__r", "__b")


def aligned_union(*tables: DataFrame) -> DataFrame:
    """All rows; columns in order of first appearance, missing ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def text_samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(text): lines of .txt files or records of .jsonl files; a mix of the two is an error."""
    kinds = {Path(p).suffix for p in paths}
    if kinds - {".txt", ".jsonl", ".json"} or len(kinds & {".txt"}) + bool(kinds & {".jsonl", ".json"}) != 1:
        raise ValueError(f"mixed or unknown types: {sorted(kinds)}")
    return spark.read.text(paths).select(F.col("value").alias("text")) if kinds == {".txt"} else spark.read.schema("text string").json(paths)


def tab_separated(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Names are given, so a header line is data."""
    return spark.read.csv(path, sep="\t", header=False, schema=", ".join(f"`{c}` string" for c in columns))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """One prompt a line, trimmed; blank lines stay."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("prompt"))


def system_prompt(path: str | None, default: str) -> str:
    text = Path(path).read_text(encoding="utf-8").strip() if path else default
    if not text:
        raise ValueError("the system prompt is empty")
    return text


def guard(output: str, inputs: list[str]) -> None:
    """Refuses an output inside an input or the reverse (paths of one file system)."""
    out = Path(output).resolve()
    for i in map(lambda p: Path(p).resolve(), inputs):
        if out == i or out in i.parents or i in out.parents:
            raise ValueError(f"{output} and {i} overlap")


def write_json(df: DataFrame, path: str, overwrite: bool = False, split: str | None = None) -> None:
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(split) if split else w).json(path)


def write_aligned(df: DataFrame, prompts_path: str, references_path: str, *order: str, prompt: str = "prompt", per_folder: int = 1_000_000, overwrite: bool = False) -> None:
    """Prompts as text, one a line with its white space collapsed, and the rows as JSON: folder by folder (part=0, 1, ...)
    line i of the one belongs to line i of the other. The rows get ordinal and input; a null id becomes eval-<ordinal>."""
    flat = T.normalize_join(F.col(prompt))
    rows = with_ordinal(df, *order).withColumns({"input": flat, "part": F.floor(F.col("ordinal") / per_folder)})
    ident = F.format_string("eval-%06d", "ordinal")
    rows = rows.withColumn("id", F.coalesce(F.col("id").cast("string"), ident) if "id" in df.columns else ident)
    placed = rows.repartition("part").sortWithinPartitions("part", "ordinal")
    mode = "overwrite" if overwrite else "errorifexists"
    placed.select("part", F.col("input").alias("value")).write.mode(mode).partitionBy("part").text(prompts_path)
    placed.drop(*([prompt] if prompt != "input" else [])).write.mode(mode).partitionBy("part").json(references_path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_review_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Header, arrays joined by semicolons, structs as JSON."""
    cols = [F.concat_ws(";", c).alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def content_hash(df: DataFrame) -> str:
    """Order-independent: count, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    r = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return ":".join(str(x) for x in r)


def manifest(df: DataFrame, by: str, **facts) -> str:
    """JSON: counts by a column, the table's content hash, and the given facts."""
    counts = {str(r[0]): r[1] for r in df.groupBy(by).count().collect()}
    return json.dumps({"counts": counts, "content_hash": content_hash(df), **facts}, ensure_ascii=False, sort_keys=True, indent=1)


def markdown_table(df: DataFrame, title: str, rows: int = 200) -> str:
    """A report of a small result."""
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if x is None else str(x) for x in r) + " |\n" for r in df.limit(rows).collect())
