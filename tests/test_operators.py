"""Literal cases of the operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import metrics, rewards
from millrace.functions import text as T
from millrace.operators import checks, convo, curriculum, evals, packing, prefs, quality, retrieval, review, sampling, templates
from millrace.sources import files
from millrace.streaming import ingest


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*columns).first()


def test_quotes(spark):
    rows = [("王曰：“其言‘可也’，善。”",), ("王曰：“其言",), ("”反“",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(T.quotes_balanced(F.col("x"))).collect()]
    assert got == [True, False, False, True]


def test_clean_reasons(spark):
    long_ = "天下大乱而诸侯并起争夺中原百姓流离失所不能安居乐业"
    rows = [
        ("c2m", "学而时习之", "学习并且时常温习", None, "accepted"), ("c2m", "学而时习之", "x", "yes", "has_box"), ("other", "a", "b", None, "unsupported_task"), ("m2c", " ", "b", None, "missing_text"),
        ("c2m", "学而", "学习", None, "input_too_short"), ("punctuate", long_, long_, None, "insufficient_punctuation"), ("punctuate", long_, "天下大乱，而诸侯并起，争夺中原。百姓流离失所，不能安居乐业。", None, "accepted"),
        ("punctuate", "学而时习之", "。学而时习之", None, "leading_boundary_punctuation"), ("punctuate", "学而时习之", "学而时习也。", None, "punctuation_text_mismatch"),
    ]
    df = spark.createDataFrame(rows, "task string, a string, b string, box string, want string")
    got = df.select("want", quality.clean_reason(F.col("task"), F.col("a"), F.col("b"), F.col("box")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_audit_flags(spark):
    rows = [("c2m", "元嘉三年四月，帝幸建康宫室大臣朝贺", "公司股票价格上涨百分之五市场情绪乐观"), ("c2m", "同文同文", "同文同文"), ("punctuate", "同文同文", "同文同文")]
    got = [set(r[0]) for r in spark.createDataFrame(rows, "t string, a string, b string").select(quality.audit_flags(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert {"number_or_date_mismatch", "low_character_overlap"} <= got[0]
    assert "identical_input_output" in got[1]
    assert "identical_input_output" not in got[2]


def test_f1_and_boundaries(spark):
    df = spark.createDataFrame([(1, "学而 时习之", "学而时习之"), (2, "", "a"), (3, "学，而。", "学。而，")], "id int, o string, r string")
    got = {r["id"]: tuple(r)[1:] for r in metrics.char_scores(df, "id", "o", "r").collect()}
    assert got[1] == (1.0, 1.0, 1.0)
    assert got[2] == (0.0, 0.0, 0.0)
    assert {r["id"]: r["position_f1"] for r in metrics.boundary_scores(df, "id", "o", "r", typed=False).collect()}[3] == 1.0
    assert {r["id"]: r["boundary_f1"] for r in metrics.boundary_scores(df, "id", "o", "r").collect()}[3] < 1.0


def test_rewards(spark):
    r = one(spark, rewards.preservation_guard(F.lit("学，而"), F.lit("学而")), rewards.preservation_guard(F.lit("学"), F.lit("学而")), rewards.gated(F.lit(0.8), F.lit("学"), F.lit("学而")), rewards.direct_format(F.lit("<think>x")), rewards.math_accuracy(F.lit("<answer>1,200</answer>"), F.lit("#### 1200")))
    assert tuple(r) == (1.0, -1.0, 0.0, 0.0, 1.0)
    assert tuple(one(spark, T.think_answer(F.lit("x <answer> 1 </answer>")), T.think_answer(F.lit(" 7 ")), T.think_answer(F.lit(None).cast("string")))) == ("1", "7", "")
    assert one(spark, T.boxed_answer(F.lit(r"so \boxed{1} and \boxed{\frac{a}{b}} end")))[0] == r"\frac{a}{b}"
    assert one(spark, rewards.preservation_v1(F.lit("abc"), F.lit("abd")))[0] == pytest.approx(1 / 3)


def test_difficulty(spark):
    s, reasons = one(spark, F.struct(*[c.alias(n) for c, n in zip(curriculum.difficulty(F.lit("太祖三年，帝不悦，故遣将军伐之，遂平。"), F.lit("那" * 60)), ("s", "r"), strict=True)]))[0]
    assert s >= 7
    assert {"date_or_number", "negation", "logical_relation"} <= set(reasons)


def test_source_split(spark):
    rows = [(f"{t}{i}", t, f"{t}-src{i % n}") for t, n in (("c2m", 10), ("m2c", 10), ("punctuate", 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, task string, source string")
    got = sampling.anchored_source_split(df, "source", "task", "id", (0.6, 0.2, 0.2), "42", minimum=2)
    assert checks.source_isolation(got).count() == 0
    by = {(r["task"], r["split"]): r["n"] for r in got.groupBy("task", "split").agg(F.count_distinct("source").alias("n")).collect()}
    assert all(by[(t, s)] >= 2 for t in ("c2m", "m2c", "punctuate") for s in ("validation", "test"))
    assert got.count() == len(rows)
    few = df.where("source IN ('c2m-src0', 'c2m-src1', 'm2c-src0', 'm2c-src1')").unionAll(df.limit(1).select(F.lit("lone").alias("id"), "task", F.lit(" ").alias("source")))
    got = sampling.anchored_source_split(few, "source", "task", "id", (1 / 3, 1 / 3, 1 / 3), 7)
    assert {r["split"] for r in got.select("split").distinct().collect()} == {"train", "validation", "test"}
    assert got.where("split = 'train'").select("task").distinct().count() == 2


def test_group_split_and_cap(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, prompt string")
    got = {r["id"]: r["split"] for r in sampling.group_split(df, F.col("prompt"), 0.5, "1").collect()}
    assert got[1] == got[2] != got[3]
    assert sampling.capped(df, "prompt", 1, "s", F.col("id").cast("string")).count() == 2


def test_reviews(spark):
    c = spark.createDataFrame([("a", "c2m", "s", "k", "p", "r"), ("b", "c2m", "s", "k", "p", "r")], "id string, task string, source string, category string, prompt string, reference string")
    c = review.pending(c)
    r = spark.createDataFrame([("a", "c2m", "approved", "high", "better", "fine", "me"), ("b", "c2m", "rejected", "low", "", "bad", "me"), ("z", "c2m", "approved", "high", "", "x", "me")], "id string, task string, review_status string, confidence string, approved_reference string, review_notes string, reviewer string")
    assert {(x["id"], x["problem"]) for x in review.merge_problems(c, r).collect()} == {("z", "unknown_id")}
    m = review.merged(c, r).collect()
    assert [(x["id"], x["reference"], x["reference_corrected"]) for x in m] == [("a", "better", True)]
    with pytest.raises(ValueError, match="all_found"):
        checks.require(checks.all_found(r.select("id"), c))
    conv = c.withColumn("conversations", convo.from_qa(F.col("prompt"), F.col("reference")))
    got = {x["id"]: (x["review_action"], x["a"]) for x in review.apply_reviews(conv, r).select("id", "review_action", convo.last_of(F.col("conversations"), convo.ASSISTANT).alias("a")).collect()}
    assert got == {"a": ("corrected", "better"), "b": ("removed", "r")}


def test_review_errors(spark):
    r = spark.createDataFrame([("a", "approved", "", "old")], "id string, review_status string, approved_reference string, reference string")
    conv = lambda *values: spark.createDataFrame([("a", v) for v in values], "id string, v string").withColumn("conversations", convo.from_qa(F.lit("q"), F.col("v")))
    assert review.apply_reviews(conv("old "), r).count() == 1
    for wrong, why in ((conv("new"), "not the reviewed one"), (conv("old", "old"), "repeats")):
        with pytest.raises(Exception, match=why):
            review.apply_reviews(wrong, r).collect()


def test_fifo_and_zip(spark):
    refs = spark.createDataFrame([(0, "x", "r0"), (1, "x", "r1"), (2, "y", "r2")], "ordinal int, input string, reference string")
    preds = spark.createDataFrame([(0, " x", "p0"), (1, "x", "p1")], "ordinal int, inp string, output string")
    assert {(r["reference"], r["output"]) for r in evals.fifo_join(refs, preds, "input", "inp").collect()} == {("r0", "p0"), ("r1", "p1")}
    b = refs.select("ordinal", "input", F.col("reference").alias("output"))
    with pytest.raises(Exception, match="missing"):
        evals.fifo_join3(refs, b, b.where("ordinal < 2"), "input").count()
    assert evals.zip_join(refs, b, "input").count() == 3
    with pytest.raises(Exception, match="line up"):
        evals.zip_join(refs, b.where("ordinal < 2"), "input").count()


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d"), (1, 5, "user", "e"), (1, 6, "assistant", "f"), (1, 7, "user", "g")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r["user_text"], r["assistant_text"]) for r in convo.turn_pairs(t).collect()} == {("a\nb", "c"), ("e", "f")}
    c = convo.collected(t)
    assert sorted(len(r["prefix"]) for r in convo.prefixes(c, "conv_id", "messages").collect()) == [4, 5, 7]
    conv = spark.createDataFrame([([("system", "s"), ("human", "do\n\nbody: x"), ("gpt", " y ")],)], "c array<struct<from:string,value:string>>")
    r = conv.select(convo.last_of(F.col("c"), convo.ASSISTANT), convo.body_after_last_blank(convo.last_of(F.col("c"), convo.HUMAN)), convo.prompt_and_answer(F.col("c"))["answer"], convo.shape_error(F.col("c")), quality.valid_conversation(F.col("c"))).first()
    assert tuple(r) == ("y", "body: x", " y ", None, True)


def test_candidates(spark):
    df = spark.createDataFrame([("r", ["甲", " ", "乙", "甲 "])], "id string, c array<string>")
    assert [(r["pos"], r["candidate"]) for r in prefs.distinct_candidates(df, "id", "c").orderBy("pos").collect()] == [(0, "甲"), (2, "乙")]
    auto, flags = prefs.candidate_reasons(F.lit("punctuate"), F.lit("学而时习之"), F.lit("学而时习也。"), F.lit("学而时习之。"))
    assert tuple(one(spark, auto, flags)) == (["punctuation_text_changed"], [])
    auto, flags = prefs.candidate_reasons(F.lit("c2m"), F.lit("学而时习之"), F.lit("学而时习之"), F.lit("学了又时常温习它"))
    assert one(spark, flags)[0] == ["source_echo_without_translation"]
    assert one(spark, T.adjacent_repetition(F.lit("0123456789" * 2)), T.adjacent_repetition(F.lit("abc" * 3)))[:] == (True, False)


def test_protected(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", [])], "id string, flags array<string>")
    assert {r["id"] for r in quality.without_flags(df, "flags", ["x"]).collect()} == {"b", "c"}
    with pytest.raises(Exception, match="protected"):
        quality.without_flags(df, "flags", ["x"], df.where("id = 'a'")).collect()


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"id": "1", "n": 2}\n\n{bad\n[1]\n{"id": "2"}\n', encoding="utf-8")
    lines = files.json_lines(spark, str(p), "id string, n int")
    assert tuple(files.line_stats(lines).first()) == (5, 1, 1, 1, 2)
    assert sorted(r["id"] for r in files.tolerant(lines).collect()) == ["1", "2"]
    with pytest.raises(Exception, match="a.jsonl"):
        files.strict(lines).collect()
    with pytest.raises(ValueError, match="mixed"):
        files.text_samples(spark, ["a.txt", "b.jsonl"])
    with pytest.raises(ValueError, match="overlap"):
        files.guard(str(tmp_path), [str(p)])
    df = files.with_ordinal(spark.range(100).withColumn("k", F.lit(7)), "id")
    assert [r["ordinal"] for r in df.orderBy("id").collect()] == list(range(100))
    files.write_json(df, str(tmp_path / "out"), split="k")
    assert spark.read.json(str(tmp_path / "out")).count() == 100
    assert json.loads(files.manifest(df, "k", seed=1))["counts"] == {"7": 100}
    assert files.content_hash(df) == files.content_hash(df.repartition(3))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"text": "long enough"}\n{"text": ""}\n')
    reason = F.when(F.col("text") == "", "missing_text").otherwise("accepted")
    for _ in range(2):
        ingest.run_available(ingest.cleaned_stream(spark, str(tmp_path / "in"), "text string", reason), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == 1


def test_retrieval(spark):
    assert retrieval.split_chunks("One. Two. Three.", 9, 0) == ["One. Two.", "Three."]
    assert retrieval.split_chunks("One. Two. Three.", 9, 3) == ["One. Two. Thr", "Three."]
    assert retrieval.split_chunks("Long sentence here. A.", 5, 0) == ["Long sentence here.", "A."]
    assert retrieval.split_chunks("", 5, 2) == []
    assert retrieval.split_chunks("一二三。四五六七八九十", 6, 3) == ["一二三。 四五六", "四五六七八九 十", "十"]
    df = spark.createDataFrame([(1, "<p>a &amp; b</p><script>x</script><div>c</div>")], "id int, h string")
    assert [r["line"] for r in retrieval.html_lines(df, "id", "h").orderBy("line_no").collect()] == ["a & b", "c"]
    assert one(spark, T.number_contexts(F.array(F.lit("x"), F.lit("y"))))[0] == '[1]\t "x"\n[2]\t "y"'


def test_packing_and_templates(spark):
    ids, labels = packing.encode_turns([([1, 2], [3])], 8, 0)
    assert (ids, labels) == ([1, 2, 3, 0], [-100, -100, 3, 0])
    df = spark.createDataFrame([("g", 1, [1, 2, 3]), ("g", 2, [4, 5])], "g string, o int, t array<int>")
    assert [r["tokens"] for r in packing.packed(df, "g", "o", "t", 2).orderBy("block_no").collect()] == [[1, 2], [3, 4]]
    pairs = F.array(F.struct(F.lit("q").alias("user"), F.lit("a").alias("assistant")), F.struct(F.lit("r").alias("user"), F.lit("").alias("assistant")))
    assert one(spark, templates.render("mistral", pairs))[0] == "[INST] q [/INST]a</s>[INST] r [/INST]"
    for style in templates.TOOL_FORMATS.values():
        assert style.found(style.calls([("get", '{"x": 1}')])) == [("get", '{"x": 1}')]
        assert style.found("nothing here") is None
    for name in ("glm4", "llama3"):
        with pytest.raises(ValueError, match="one call"):
            templates.TOOL_FORMATS[name].calls([("a", "{}"), ("b", "{}")])
    assert templates.tagged_found('<tool_call>{"name": "a", "arguments": {}}</tool_call> and more') is None
    tools = [{"name": "get", "description": "Gets.", "parameters": {"properties": {"x": {"type": "string", "description": "what", "enum": ["a", "b"]}, "y": {"type": "array", "items": {"type": "int"}}}, "required": ["x"]}}]
    assert "> Tool Name: get\nTool Description: Gets.\nTool Args:\n  - x (string, required): what, should be one of [a, b]\n  - y (array): , where each item should be int\n\nUse the" in templates.react_tools(tools)
    conv = spark.createDataFrame([([("system", "be brief"), ("human", "q"), ("function_call", '{"name": "get", "arguments": {"x": 1}}'), ("observation", "1"), ("gpt", "one"), ("note", "x")],), (None,)], "c array<struct<from:string,value:string>>")
    got = [r[0] for r in conv.select(templates.chat_messages("qwen", json.dumps(tools))(F.col("c"))).collect()]
    assert got[1] is None
    assert [(m["role"], m["content"]) for m in got[0]][1:] == [("user", "q"), ("assistant", '<tool_call>\n{"name": "get", "arguments": {"x": 1}}\n</tool_call>'), ("user", "<tool_response>\n1\n</tool_response>"), ("assistant", "one")]
    assert got[0][0]["content"].startswith("be brief\n\n\n\n# Tools")
    calls = spark.createDataFrame([("Action: get\nAction Input: {\"x\": 1}",), ("no",), (None,)], "t string").select(templates.found_calls("default")(F.col("t"))).collect()
    assert [r[0] and [tuple(c) for c in r[0]] for r in calls] == [[("get", '{"x": 1}')], None, None]
