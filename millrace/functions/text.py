"""Column functions over text. Character classes are spelled out, since engines' \\s and \\w are ASCII.

Each takes and returns Columns; null stays null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and word characters (letters, numbers, underscore).
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WORD = r"[^\p{L}\p{N}_]"

# Punctuation marks, quotes and characters that the rules name.
MARKS = "，。！？；：、,.!?;:"
SENTENCE_BOUNDARIES = "。！？；：.!?;:"
SENTENCE_ENDS = "。！？.!?"
CLOSING = "”’」』》\""
QUOTES = {"“": "”", "‘": "’", "「": "」", "『": "』"}
REWARD_MARKS = "，。！？；：、‘’“”（）《》〈〉【】〔〕—…·,.!?;:'\"()[]-"
COMMON_CHARACTERS = "之其而以于为者也矣乎焉乃则所与及不无有是曰云人将中上下来"

# The three number patterns (audit, triage, selection) and the leak pattern.
AUDIT_NUMBER = r"\p{Nd}+|[〇零一二三四五六七八九十百千]+[年月日]"
TRIAGE_NUMBER = r"(?:\p{Nd}+(?:\.\p{Nd}+)?(?:年|月|日|人|里|丈|尺|亩|次|国|岁)?|[〇零一二三四五六七八九十百千万亿两]+(?:年|月|日|人|里|丈|尺|亩|次|国|岁)|正月|初[一二三四五六七八九十]|[甲乙丙丁戊己庚辛壬癸][子丑寅卯辰巳午未申酉戌亥])"
SELECT_NUMBER = r"\p{Nd}+|[一二三四五六七八九十百千万亿两〇零]+(?:年|月|日|岁|人|军|里|丈|枚|次)?"
LEAK = r"(?i)<\/?(?:think|answer)>|作为(?:一个)?AI|无法回答|抱歉"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in chars) + "]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def normalize_ws(x: Column) -> Column:
    """All white space removed; null becomes empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), f"{WS}+", "")


def normalize_join(x: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"{WS}+", " "))


def normalize_content(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def normalize_audit(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\x{3400}-\x{9fff}A-Za-z0-9]", ""))


def content_core(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), NON_WORD, "")


def text_core(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}_\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]", "")


def flatten_eval(x: Column) -> Column:
    return strip(F.regexp_replace(x, f"{WS}+", " "))


def flatten_lines(x: Column) -> Column:
    return F.regexp_replace(x, r"[\r\n]+", " ")


def flatten_single(x: Column) -> Column:
    return F.translate(x, "\r\n", "  ")


def characters(x: Column) -> Column:
    """Code points as an array; empty text has none."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))


def quotes_balanced(x: Column) -> Column:
    """Whether the paired quotes nest."""
    opening, closing = "".join(QUOTES), "".join(QUOTES.values())

    def step(stack: Column, c: Column) -> Column:
        close = F.instr(F.lit(closing), c)
        top = F.substring(stack, 1, 1)
        return (
            F.when(stack == "!", stack)
            .when(F.instr(F.lit(opening), c) > 0, F.concat(c, stack))
            .when(close > 0, F.when(top == F.translate(c, closing, opening), F.substring(stack, 2, 1 << 30)).otherwise(F.lit("!")))
            .otherwise(stack)
        )

    return F.aggregate(characters(F.regexp_replace(x, f"[^{opening}{closing}]", "")), F.lit(""), step) == ""


def count_of(x: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(x, "[^" + _class(chars)[1:], ""))


def punctuation_density(x: Column, normalized: Column) -> Column:
    """Marks of a text for each character of its normalised form."""
    return count_of(x, MARKS) / F.greatest(F.length(normalized), F.lit(1))


def has_boundary(x: Column) -> Column:
    return x.rlike(_class(SENTENCE_BOUNDARIES))


def leads_with_boundary(output: Column, source: Column) -> Column:
    """The output starts with the end of a sentence, and the source does not start with a closing quote."""
    first = F.substring(strip(output), 1, 1)
    return first.rlike(f"^{_class(SENTENCE_ENDS)}$") & ~F.coalesce(F.substring(strip(source), 1, 1).rlike(f"^{_class(CLOSING)}$"), F.lit(False))


def cjk_characters(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"([\x{3400}-\x{9fff}])"), F.lit(1))


def cjk_jaccard(a: Column, b: Column) -> Column:
    rare = lambda x: F.array_except(F.array_distinct(cjk_characters(x)), F.array(*[F.lit(c) for c in COMMON_CHARACTERS]))
    x, y = rare(a), rare(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def numbers(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def number_set(x: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(numbers(x, pattern)))


def adjacent_repetition(x: Column, least: int = 10, most: int = 80) -> Column:
    """Some block of 10 to 80 characters follows itself; meant for outputs, not corpora."""
    return normalize_ws(x).rlike(rf"(?s)(.{{{least},{most}}})\1")


def format_leak(x: Column) -> Column:
    return x.rlike(LEAK)


def tag_leak(x: Column) -> Column:
    return x.contains("<think>") | x.contains("<answer>")


def length_ratio(output: Column, reference: Column) -> Column:
    return F.length(normalize_ws(output)) / F.greatest(F.length(normalize_ws(reference)), F.lit(1))


def exact_match(a: Column, b: Column) -> Column:
    return normalize_ws(a) == normalize_ws(b)


def truthy(x: Column) -> Column:
    """Of texts: 1, true, yes or y. (Numbers and booleans: pass ``x <> 0``, ``x``.)"""
    return F.coalesce(F.lower(strip(x.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("␟", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 20))


def hash_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def stable_key(seed: int | str, namespace: str, ident: Column, source: Column) -> Column:
    """SHA-256 of seed, namespace, id and source joined by NUL; null counts as empty."""
    nul = F.lit("\0")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.lit(str(seed)), nul, F.lit(namespace), nul, text(ident), nul, text(source)), 256)


def hash_point(*parts: Column | str) -> Column:
    """In [0, 1): the first eight bytes of the hash over 2**64."""
    return F.conv(F.substring(hash_key(*parts), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def pair_signature(human: Column, answer: Column) -> Column:
    return F.sha2(F.concat(content_core(human), F.lit("\0"), content_core(answer)), 256)


def prompt_key(messages: Column) -> Column:
    return F.sha2(F.to_json(messages), 256)


def head_md5(content: Column) -> Column:
    return F.md5(F.substring(content, 1, 1 << 20))


def boxed_answer(x: Column) -> Column:
    """Content of the last \\boxed{...} or \\fbox{...}, whose braces may nest; null if there is none."""
    tail = F.regexp_extract(x, r"(?s)^.*\\(?:boxed|fbox)\{(.*)$", 1)
    chars = characters(tail)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(s["depth"] == 0, 0).when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(depth == 0, s["out"]).otherwise(F.concat(s["out"], c)).alias("out"))

    done = F.aggregate(chars, start, step)
    plain = F.regexp_extract(x, r"\\boxed ([^$]*)", 1)
    return F.when(plain != "", plain).when(x.rlike(r"\\(boxed|fbox)\{"), F.when(done["depth"] == 0, done["out"]))


def think_answer(x: Column) -> Column:
    """The trimmed text between answer tags; without them, the whole text; null becomes empty."""
    found = F.when(x.rlike(r"(?s)<answer>.*?</answer>"), F.regexp_extract(x, r"(?s)<answer>(.*?)</answer>", 1)).otherwise(x)
    return F.coalesce(strip(found), F.lit(""))


def think_format(x: Column) -> Column:
    return x.rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>$")


def final_number(x: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(x, r"####\s*([-+]?[\d,.]*\d)", 1), ",", "").try_cast("double")


def is_chinese(x: Column) -> Column:
    return x.rlike(r"[\x{4e00}-\x{9fff}]")


def stop_trim(x: Column, stop: str) -> Column:
    return F.substring_index(x, stop, 1)


def react_parts(x: Column) -> Column:
    """Struct of action, action_input and final_answer."""
    take = lambda p: F.nullif(F.trim(F.regexp_extract(x, p, 1)), F.lit(""))
    return F.struct(
        take(r"(?s)Action:\s*(.*?)\s*(?:\n|Action Input:|$)").alias("action"),
        take(r"(?s)Action Input:\s*(.*?)\s*(?:\nObservation:|Observation:|$)").alias("action_input"),
        take(r"(?s)Final Answer:\s*(.*)$").alias("final_answer"),
    )


def expand_command(x: Column, commands: dict[str, str]) -> Column:
    """'/name rest' becomes the instruction of that name, a blank line and the rest."""
    out = x
    for name, instruction in commands.items():
        out = F.when(x.startswith(f"{name} "), F.concat(F.lit(f"{instruction}\n\n"), strip(F.substring(x, len(name) + 1, 1 << 30)))).otherwise(out)
    return out


def number_contexts(chunks: Column) -> Column:
    """'[1]\\t "text"' lines of an array of texts."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit(']\t "'), c, F.lit('"'))), "\n")
