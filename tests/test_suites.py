"""Suites as data: each task with its own examples, stops and sizes."""

from pyspark.sql import functions as F

from kdframe import registry
from kdframe.operators import eval_prompts as ep


def plan(spark, *lines):
    suite = ep.parse_suite(spark.createDataFrame([(line,) for line in lines], "value string"))
    return ep.expand_suite(suite, ep.task_registry(spark))


def test_lines_name_tasks_or_families(spark):
    found = plan(spark, "custom|bbh|3|1", "custom|gsm8k|5|0", "extended|ifeval|0|0", "custom|arc:easy|1|1")
    rows = {r["task"]: r for r in found.collect()}
    assert len(rows) == 29 and "ifeval" not in rows and "arc:challenge" not in rows
    assert (rows["bbh:snarks"]["shots"], rows["bbh:snarks"]["truncate"], rows["gsm8k"]["truncate"]) == (3, True, False)


def test_examples_by_task(spark):
    tasks = ("bbh:snarks", "math:algebra", "gsm8k", "mmlu_pro")
    rows = [(t, i, s, f"{t} {s} {i}?", [" no", " yes"], 1) for t in tasks for n, s in enumerate(("train", "test", "validation", "fewshot")) for i in range(10 * n, 10 * n + 6)]
    prompts = spark.createDataFrame(rows, "task string, item_id int, split string, query string, choices array<string>, gold_index int")
    asked = ep.suite_prompts(prompts, plan(spark, "custom|bbh|2|1", "custom|math|3|1", "custom|gsm8k|9|1", "custom|mmlu_pro|0|1")).collect()
    assert {(r["task"], r["split"]) for r in asked} == {("bbh:snarks", "train"), ("math:algebra", "test"), ("gsm8k", "test"), ("mmlu_pro", "test")}
    for r in asked:
        shown = [x for x in r["few_shot"].split("\n\n") if x]
        assert len(shown) == {"bbh:snarks": 2, "math:algebra": 3, "gsm8k": 6, "mmlu_pro": 0}[r["task"]]
        assert all(x.endswith(" yes") and not x.startswith(r["query"]) for x in shown)
        if r["task"] == "math:algebra":
            assert shown == [f"math:algebra fewshot {i}? yes" for i in range(30, 33)]
    assert ep.suite_prompts(prompts, plan(spark, "custom|none|2|1")).collect() == []


def test_stops_and_sizes_by_row(spark):
    rows = [(1, "one two Problem: x", ["Problem:"], 1), (2, "one Question: Problem:", ["Problem:", "Question"], None), (3, "a b c", [], 2), (4, "kept", None, None), (5, "Qx", ["Q"], 3)]
    df = spark.createDataFrame(rows, "id int, text string, stops array<string>, size int")
    cut = ep.cut_at_stops(F.col("text"), F.col("stops"))
    got = df.select("id", cut.alias("cut"), ep.cap_tokens(cut, F.col("size")).alias("capped"))
    assert [tuple(r) for r in got.sort("id").collect()] == [
        (1, "one two ", "one"), (2, "one ", "one "), (3, "a b c", "a b"), (4, "kept", "kept"), (5, "", "")]
    assert df.select(ep.cut_at_stops(F.col("text"), ["two", "b"]).alias("x")).sort("id").first()["x"] == "one "


def test_prompts_by_kind(spark):
    math = spark.createDataFrame([("math:algebra", 1, "test", "p", "s")], "task string, item_id int, split string, problem string, solution string")
    bbh = spark.createDataFrame([("bbh:snarks", 2, "train", "i", "t")], "task string, item_id int, split string, input string, target string")
    got = {r["item_id"]: (r["query"], r["choices"]) for r in registry.build_prompts({"math": math, "bbh": bbh}).collect()}
    assert got == {1: ("Problem:\np\n\nSolution:\n", ["s\n"]), 2: ("Question: i\nAnswer: ", ["t"])}
