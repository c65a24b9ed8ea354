"""Literal cases of reports, selection, exchanges, vocabularies and aligned exports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import checks, convo, evals, prefs, quality, review, sampling, vocabulary
from millrace.sources import files


def test_selection(spark):
    rows = [
        (1, "c2m", "学而时习之", "学了又时常温习它", ["学了又时常温习它", " 学了又时常温习它 "]),
        (2, "c2m", "学而时习之", "学了又时常温习它", None),
        (3, "c2m", "学而时习之", "学了又时常温习它", []),
        (4, "c2m", "学而时习之", "学了又时常温习它", ["学而，时习之。", "学了又时常温习了它"]),
        (5, "punctuate", "三年帝崩", "三年，帝崩。", ["五年，帝崩。", "三年帝崩。"]),
        (6, "m2c", "他说", "曰", ["抱歉，我无法回答"]),
        (7, "c2m", "学", "学习", ["", " "]),
    ]
    df = spark.createDataFrame(rows, "id int, task string, source_text string, reference string, candidate_outputs array<string>")
    got = prefs.selected(df)
    by = {r["id"]: r for r in got.collect()}
    assert len(by) == 7
    assert [(i, by[i]["selection_reason"]) for i in (1, 2, 3, 7)] == [(1, "all_candidates_equivalent_to_reference"), (2, "no_candidates"), (3, "no_candidates"), (7, "all_candidates_equivalent_to_reference")]
    assert (by[4]["status"], by[4]["rejected"], by[4]["review_flags"]) == ("manual", "学而，时习之。", ["source_echo_without_translation"])
    assert (by[5]["status"], by[5]["rejected"], by[5]["auto_reasons"]) == ("approved", "五年，帝崩。", ["punctuation_text_changed"])
    assert by[6]["status"] == "approved" and by[6]["auto_reasons"] == ["format_or_refusal_leak"]
    counts = {r["name"]: r["n"] for r in prefs.selection_counts(got).collect()}
    assert counts == {"no_candidates": 2, "all_candidates_equivalent_to_reference": 2, "approved": 2, "reason:punctuation_text_changed": 1, "reason:format_or_refusal_leak": 1, "manual": 1, "review_flag:source_echo_without_translation": 1}


def test_top_per_task(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", 2.0), (4, "b", 2.5), (5, "c", 9.0)], "id int, task string, priority double")
    assert [r["id"] for r in prefs.top_per_task(df, ("a", "b"), 2).collect()] == [2, 4, 3]


def test_exchanges(spark):
    said = lambda *m: [(r, c) for r, c in m]
    rows = [
        (0, said(("assistant", "x"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d"), ("system", "s"), ("user", "e"))),
        (1, said()), (2, None), (3, said(("user", None), ("assistant", None))), (4, said(("system", "t"), ("assistant", "z"))),
    ]
    df = spark.createDataFrame(rows, "id int, m array<struct<role string, content string>>")
    got = {r["id"]: r for r in df.select("id", convo.exchanges(F.col("m")).alias("all"), convo.exchanges(F.col("m"), trailing=False).alias("whole"), convo.preference_prompt(F.col("m")).alias("p")).collect()}
    plain = lambda x: None if x is None else [tuple(y) for y in x]
    assert plain(got[0]["all"]) == [("a\nb", "c"), ("e", "")]
    assert plain(got[0]["whole"]) == [("a\nb", "c")]
    assert plain(got[0]["p"]) == [("system", "s"), ("user", "a\nb"), ("assistant", "c"), ("user", "e")]
    assert plain(got[1]["all"]) == [] and plain(got[2]["all"]) is None and plain(got[1]["p"]) == []
    assert plain(got[3]["all"]) == [("", "")] and plain(got[4]["all"]) == [] and plain(got[4]["p"]) == [("system", "t")]


def test_prepared(spark):
    rows = [("7", " c2m ", "译", " 学 ", "学习 ", "论语", "经"), (" ", "c2m", "译", "学", "学习", None, "")]
    a, b = convo.prepared(spark.createDataFrame(rows, "id string, task string, instruction string, input string, output string, source string, category string"), "系统", "u", "l", "x-").collect()
    assert (a["id"], a["task"], a["source"], a["category"]) == ("7", "c2m", "论语", "经")
    assert [m["value"] for m in a["conversations"]] == ["系统", "译\n\n学", "学习"]
    assert b["id"].startswith("x-") and len(b["id"]) == 22 and b["source"] == f"未知出处/{b['id']}" and b["category"] == "未分类"


def test_comparison(spark):
    rows = [("a", -0.06, ["x"], ["x", "z", "y"]), ("a", 0.05, [], []), (None, 0.2, ["x"], [])]
    df = spark.createDataFrame(rows, "task string, delta double, base array<string>, cand array<string>")
    got = {(r["task"], r["model"], r["flag"]): r["n"] for r in evals.triage_summary(df, "task", "base", "cand", "delta").collect()}
    assert got == {
        ("a", "rows", "rows"): 2, ("a", "baseline", "x"): 1, ("a", "candidate", "x"): 1, ("a", "candidate", "y"): 1, ("a", "candidate", "z"): 1, ("a", "comparison", "regression"): 1,
        ("a", "comparison", "new_y"): 1, ("a", "comparison", "new_z"): 1, (None, "rows", "rows"): 1, (None, "baseline", "x"): 1, (None, "comparison", "improvement"): 1,
    }


def test_vocabulary(spark):
    t = lambda rows: spark.createDataFrame(rows, "piece string, ordinal int")
    base = t([("a", 0), ("b", 1)]).withColumn("score", F.lit(-2.0))
    got = vocabulary.merged(base, t([("b", 0), ("c", 1), ("c", 2), (None, 3)]), t([("d", 0), ("c", 1), ("a", 2)])).orderBy("part", "ordinal").collect()
    assert [(r["piece"], r["score"], r["part"], r["ordinal"]) for r in got] == [("a", -2.0, 0, 0), ("b", -2.0, 0, 1), ("c", 0.0, 1, 1), ("d", 0.0, 2, 0)]
    words = spark.createDataFrame([("x", 3, 0), ("y", 5, 1), ("z", 3, 2)], "word string, freq int, ordinal int")
    assert [r["word"] for r in vocabulary.most_frequent(words, 2).collect()] == ["y", "x"]


def test_limits():
    assert sampling.limits("c2m = 10, ,m2c=-1,c2m=3") == {"c2m": 3, "m2c": -1}
    for bad in ("", " , ", "c2m", "=3", "a=x", "a=-2", "a=--1"):
        with pytest.raises(ValueError):
            sampling.limits(bad)
    with pytest.raises(ValueError):
        sampling.limits("a=0", least=1)


def test_task_rows(spark):
    df = spark.createDataFrame([("a", "x"), (None, " "), ("a", "xyz")], "task string, prompt string")
    assert checks.task_rows(df, "a").count() == 2
    with pytest.raises(ValueError):
        checks.task_rows(df, "b")
    assert checks.prompts_within(df, "prompt").count() == 2 and checks.prompts_within(df, "prompt", 2).count() == 1


def test_logs(spark):
    removed = spark.createDataFrame([("1", "c2m", "s"), ("2", "m2c", None)], "id string, task string, source string")
    audits = spark.createDataFrame([("1", ["f"]), ("9", ["g"])], "id string, audit_flags array<string>")
    got = {r["id"]: (r["split"], r["audit_flags"]) for r in review.removal_log(removed, audits, "train").collect()}
    assert got == {"1": ("train", ["f"]), "2": ("train", [])}
    flagged = spark.createDataFrame([(["f", "g"],), (["f"],), ([],), (None,)], "flags array<string>")
    assert {r["flag"]: r["n"] for r in quality.removed_by_flag(flagged, "flags", ["f", "h"]).collect()} == {"f": 2}


def test_aligned(spark, tmp_path):
    rows = [(i, None if i == 3 else f"k{i}", f"p \n {i}", str(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "n int, id string, prompt string, reference string")
    a, b = str(tmp_path / "prompts"), str(tmp_path / "references")
    files.write_aligned(df, a, b, "n", per_folder=4)
    for part in range(3):
        lines = lambda root: [x for f in sorted((tmp_path / root / f"part={part}").glob("part-*")) for x in f.read_text().splitlines()]
        prompts, refs = lines("prompts"), [json.loads(x) for x in lines("references")]
        assert prompts == [r["input"] for r in refs] == [f"p {i}" for i in range(4 * part, min(10, 4 * part + 4))]
        assert [r["id"] for r in refs] == ["eval-000003" if i == 3 else f"k{i}" for i in range(4 * part, min(10, 4 * part + 4))]
