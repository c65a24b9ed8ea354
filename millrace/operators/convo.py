"""Nested conversations: array<struct<from, value>>, and their exploded form (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

HUMAN, ASSISTANT = ("human", "user"), ("gpt", "assistant")


def message(role: str, value: Column) -> Column:
    return F.struct(F.lit(role).alias("from"), value.alias("value"))


def from_raw(instruction: Column, source: Column, output: Column, system: str) -> Column:
    """System, human (instruction, blank line, input) and gpt messages of trimmed texts."""
    return F.array(message("system", F.lit(system)), message("human", F.concat(T.strip(instruction), F.lit("\n\n"), T.strip(source))), message("gpt", T.strip(output)))


def from_alpaca(instruction: Column, source: Column, output: Column) -> Column:
    body = F.when(F.coalesce(T.strip(source), F.lit("")) != "", F.concat(instruction, F.lit("\n\n"), source)).otherwise(instruction)
    return F.array(message("human", body), message("gpt", output))


def prepared(df: DataFrame, system: str, upstream: str, license: str, prefix: str = "") -> DataFrame:
    """Raw rows (id, task, instruction, input, output, source, category) as conversations: texts without white space at
    their ends; a blank id becomes the prefix and a digest of the texts as they are, a blank source 未知出处/<id>, a blank category 未分类."""
    said = lambda c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    unless_blank = lambda c, other: F.when(said(c) != "", said(c)).otherwise(other)
    rows = df.withColumn("id", unless_blank("id", T.stable_id(prefix, *[F.col(c).cast("string") for c in ("task", "source", "instruction", "input", "output")])))
    source = unless_blank("source", F.concat(F.lit("未知出处/"), F.col("id")))
    conv = from_raw(said("instruction"), said("input"), said("output"), system)
    return rows.select("id", said("task").alias("task"), source.alias("source"), unless_blank("category", F.lit("未分类")).alias("category"), F.lit(upstream).alias("upstream"), F.lit(license).alias("license"), conv.alias("conversations"))


# What is added to a problem, and what stands for a solution that is missing.
COT = " Let's think step by step and output the final answer within \\boxed{}."
NO_SOLUTION = "No solution available."


def from_problem(df: DataFrame, name: str, ordinal: str = "ordinal", start: int = 0, end: int | None = None) -> DataFrame:
    """(id, conversations) of problem and solution; the id is the name and the ordinal; rows from start to before end."""
    at = F.col(ordinal)
    rows = df.where((at >= start) & ((at < end) if end is not None and end > 0 else F.lit(True)))
    solution = F.coalesce(F.nullif(F.col("solution"), F.lit("")), F.lit(NO_SOLUTION))
    return rows.select(F.concat(F.lit(f"{name}-"), at.cast("string")).alias("id"), from_qa(F.concat(F.coalesce("problem", F.lit("")), F.lit(COT)), solution).alias("conversations"))


def system_and_question(system: str, question: Column) -> Column:
    """The two messages of a prompt that a policy answers."""
    said = lambda role, value: F.struct(F.lit(role).alias("role"), value.alias("content"))
    return F.array(said("system", F.lit(system)), said("user", question))


def exchanges(messages: Column, trailing: bool = True) -> Column:
    """Pairs (user, assistant) of chat messages: successive users joined by newline, an assistant that does not follow a
    user dropped; a user without an answer is paired with "" if trailing, else dropped. Null texts count as empty."""
    content = lambda m: F.coalesce(m["content"], F.lit(""))
    said = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))

    def cut(z: Column) -> Column:
        is_user = lambda i: F.coalesce(F.get(z["said"], i)["role"] == "user", F.lit(False))
        first = F.array_compact(F.transform(z["said"], lambda m, i: F.when(is_user(i) & ~is_user(i - 1), i)))
        last = F.array_compact(F.transform(z["said"], lambda m, i: F.when(is_user(i) & ~is_user(i + 1), i)))
        runs = F.arrays_zip(first.alias("first"), last.alias("last"))
        if not trailing:
            runs = F.filter(runs, lambda r: r["last"] < F.size(z["said"]) - 1)
        asked = lambda r: F.array_join(F.transform(F.slice(z["said"], r["first"] + 1, r["last"] - r["first"] + 1), content), "\n")
        return F.transform(runs, lambda r: F.struct(asked(r).alias("user"), F.coalesce(F.get(z["said"], r["last"] + 1)["content"], F.lit("")).alias("assistant")))

    return F.transform(F.array(F.struct(said.alias("said"))), cut)[0]


def preference_prompt(messages: Column) -> Column:
    """The chat before a chosen and a rejected answer: the last system message if there is one, then the exchanges, where an
    empty answer is left out."""
    said = lambda role, value: F.struct(F.lit(role).alias("role"), value.alias("content"))
    system = F.filter(messages, lambda m: (m["role"] == "system") & (F.coalesce(m["content"], F.lit("")) != ""))
    system = F.slice(system, F.greatest(F.size(system), F.lit(1)), F.lit(1))
    turns = F.flatten(F.transform(exchanges(messages), lambda p: F.array(said("user", p["user"]), said("assistant", p["assistant"]))))
    return F.concat(F.transform(system, lambda m: said("system", m["content"])), F.filter(turns, lambda m: (m["role"] == "user") | (m["content"] != "")))


def preferences(df: DataFrame, messages: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds prompt, the messages before the two answers; rows where an answer is null go."""
    return df.where(F.col(chosen).isNotNull() & F.col(rejected).isNotNull()).withColumn("prompt", preference_prompt(F.col(messages)))


def from_qa(question: Column, answer: Column) -> Column:
    return F.array(message("human", question), message("gpt", answer))


def last_of(conv: Column, roles: tuple[str, ...]) -> Column:
    """The last message of a role, trimmed; empty if there is none."""
    return T.strip(F.coalesce(F.try_element_at(F.filter(conv, lambda t: t["from"].isin(*roles)), F.lit(-1))["value"], F.lit("")))


def body_after_last_blank(prompt: Column) -> Column:
    return F.substring_index(prompt, "\n\n", -1)


def body_after_first_blank(prompt: Column) -> Column:
    return F.element_at(F.split(prompt, r"\r?\n\s*\r?\n", 2), -1)


def body_after_colon(prompt: Column) -> Column:
    got = F.regexp_extract(prompt, r"(?s)^[^：:]*[：:](.*)$", 1)
    return T.strip(F.when(prompt.rlike("[：:]"), got).otherwise(prompt))


def prompt_and_answer(conv: Column) -> Column:
    """Struct: messages before the last assistant, and its text; null without a user turn before it."""
    full = F.filter(conv, lambda t: T.strip(t["value"]) != "")
    is_a = F.transform(full, lambda t: t["from"].isin(*ASSISTANT))
    back = F.array_position(F.reverse(is_a), True)
    at = F.size(full) - back + 1
    prompt = F.slice(full, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))
    ok = (back > 0) & F.exists(prompt, lambda t: t["from"].isin(*HUMAN))
    return F.when(ok, F.struct(prompt.alias("prompt"), F.try_element_at(full, at.cast("int"))["value"].alias("answer")))


def joined_users(conv: Column) -> Column:
    return F.array_join(F.transform(F.filter(conv, lambda t: t["from"].isin(*HUMAN)), lambda t: t["value"]), "\n")


def shape_error(conv: Column) -> Column:
    """Null if there is exactly one system, one user and one assistant message, none blank."""
    n = lambda *r: F.size(F.filter(conv, lambda t: t["from"].isin(*r)))
    return (
        F.when(F.exists(conv, lambda t: ~t["from"].isin("system", *HUMAN, *ASSISTANT)), "unknown_role")
        .when(F.exists(conv, lambda t: F.coalesce(T.strip(t["value"]), F.lit("")) == ""), "blank_message")
        .when((n("system") != 1) | (n(*HUMAN) != 1) | (n(*ASSISTANT) != 1), "message_count")
    )


def replace_assistant(conv: Column, value: Column) -> Column:
    """The one assistant message gets another value; other fields stay."""
    return F.transform(conv, lambda t: F.when(t["from"].isin(*ASSISTANT), t.withField("value", value)).otherwise(t))


def collected(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, messages): the turns of each conversation in order."""
    return turns.groupBy(conv).agg(F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def prefixes(conv: DataFrame, key: str, messages: str) -> DataFrame:
    """One row for each assistant message that follows some user message: the messages up to it."""
    at = F.posexplode(messages).alias("pos", "m")
    rows = conv.select("*", at)
    part = F.slice(F.col(messages), F.lit(1), F.col("pos") + 1)
    return rows.where((F.col("m.role") == "assistant") & F.exists(part, lambda x: x["role"] == "user")).withColumn("prefix", part).drop("m")


def turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, user_text, assistant_text): successive user turns merged by newline; an assistant turn that
    does not follow a user turn is dropped; a trailing user turn too."""
    w = Window.partitionBy(conv).orderBy(turn)
    said = turns.where(F.col("role").isin("user", "assistant"))
    marked = said.withColumn("island", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("island", F.coalesce("island", F.lit(0)))
    by = marked.groupBy(conv, "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct(turn, "text")))), lambda x: x["text"]), "\n").alias("user_text"),
        F.count_if(F.col("role") == "user").alias("n_users"),
        F.max(F.when(F.col("role") == "assistant", F.struct(turn, "text"))).alias("a"),
    )
    return by.where((F.col("n_users") > 0) & F.col("a").isNotNull()).select(conv, F.col(f"a.{turn}").alias(turn), "user_text", F.col("a.text").alias("assistant_text"))


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, conv_id, prompt, reference): a user turn and the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumns({"r2": F.lead("role").over(w), "reference": F.lead("text").over(w)})
    return nxt.where("role = 'user' AND r2 = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "conv_id", F.col("text").alias("prompt"), "reference")


def alternates(messages: Column) -> Column:
    """Strict user/assistant alternation from the start, of even length, after an optional system message."""
    rest = F.filter(messages, lambda m: m["role"] != "system")
    right = F.transform(rest, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return (F.size(rest) > 0) & (F.size(rest) % 2 == 0) & F.forall(right, lambda x: x)


def user_prompts(conv: DataFrame, key: str, messages: str) -> DataFrame:
    """One row for each user message: (key, pos, prompt)."""
    return conv.select(key, F.posexplode(messages).alias("pos", "m")).where("m.role = 'user'").select(key, "pos", F.col("m.content").alias("prompt"))


def tool_text(role: Column, value: Column) -> Column:
    """Observations get their label; other texts stay."""
    return F.when(role == "observation", F.concat(F.lit("Observation: "), value)).otherwise(value)


def observation(value: Column, style: str) -> Column:
    # How each format wraps an observation.
    wraps = {"qwen": ("<tool_response>\n", "\n</tool_response>"), "glm4": ("<|observation|>\n", ""), "mistral": ('[TOOL_RESULTS] {"content": ', "}[/TOOL_RESULTS]"), "default": ("Observation: ", "")}
    a, b = wraps[style]
    return F.concat(F.lit(a), value, F.lit(b))
