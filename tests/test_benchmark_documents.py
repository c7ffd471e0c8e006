"""Benchmark documents as written, read and compared, and reports that are files."""

import json

import pytest
from pyspark.sql import functions as F

from kdframe.operators import eval_reports
from kdframe.operators.eval_reports import compare_models, generation_stats
from kdframe.sources import benchmarks, tables

RUNS = "model string, prompt_idx long, prompt string, response string, generation_time double, tokens_generated long, failed boolean"
MODELS = "model string, position long, model_path string, total_params long, model_size_gb double"


def run(model, index, time, tokens, failed=False):
    return (model, index, f"p{index}", f"{model}{index}", time, tokens, failed)


@pytest.fixture
def documents(spark):
    rows = [run("z", i, 2.0, 10) for i in range(25)] + [run("m", 0, 0.0, 3), run("broken", 0, 1.0, 1, True), run("a", 3, 1.0, 20)]
    models = [("z", 0, "x/z", 10, 0.5), ("m", 1, "x/m", 20, 1.5), ("broken", 2, "x/b", 1, 1.0), ("a", 3, "x/a", 30, 2.5), ("idle", 4, "x/i", 1, 1.0)]
    return benchmarks.benchmark_documents(
        spark.createDataFrame(rows, RUNS), spark.createDataFrame(models, MODELS), failed="failed", rows=10
    )


def test_documents_keep_model_fields_and_order(spark, documents, tmp_path):
    path = str(tmp_path / "b")
    benchmarks.write_benchmark(documents, path)
    back = benchmarks.read_benchmark(spark, path)
    assert back.columns == documents.columns
    assert sorted((r.position, r.part, len(r.responses)) for r in back.collect()) == [(0, 0, 10), (0, 1, 10), (0, 2, 5), (1, 0, 1), (3, 0, 1)]
    models = {r.position: r for r in benchmarks.benchmark_models(back).collect()}
    assert tuple(models[0])[1:] == ("z", "x/z", 2.0, 10.0, 5.0, 10, 0.5)
    assert models[1].avg_tokens_per_second == 0.0
    rows = benchmarks.benchmark_responses(back, rows=10).orderBy("position", "prompt_idx").collect()
    assert [r.response for r in rows] == [f"z{i}" for i in range(25)] + ["m0", "a3"]
    assert rows[0].tokens_per_second == 5.0 and rows[25].tokens_per_second == 0.0


def test_first_and_last_by_document_order(documents):
    pair = benchmarks.compare_benchmark_models(documents).first()
    assert (pair.model_name_a, pair.model_name_b, pair.total_params_a, pair.model_size_gb_b) == ("z", "a", 10, 2.5)
    assert pair.speed_change_pct == pytest.approx(300.0)
    assert benchmarks.compare_benchmark_models(documents, 1, 0).first().speed_change_pct is None
    for first, second in ((0, 0), (0, 2), (9, 0)):
        assert benchmarks.compare_benchmark_models(documents, first, second).count() == 0
    assert benchmarks.compare_benchmark_models(documents.where("false")).count() == 0


def test_array_file_of_models(spark, tmp_path):
    def model(name, speed, answers):
        said = [{"prompt": "p", "response": a, "generation_time": 1.5, "tokens_generated": 3, "tokens_per_second": 2.0} for a in answers]
        return {
            "model_name": name, "model_path": "x/" + name, "responses": said, "avg_generation_time": 1.5, "avg_tokens_generated": 3.0,
            "total_params": 7, "model_size_gb": 0.25, "avg_tokens_per_second": speed,
        }

    (tmp_path / "b.json").write_text(json.dumps([model("same", 2.0, ["u", "v"]), model("b", 1.0, []), model("same", 3.0, ["w"])], indent=2))
    back = benchmarks.read_benchmark(spark, str(tmp_path / "b.json"), array=True)
    assert back.columns == spark.createDataFrame([], benchmarks.DOCUMENT_SCHEMA).columns
    rows = benchmarks.benchmark_responses(back).orderBy("position", "prompt_idx").collect()
    assert [(r.position, r.model_name, r.prompt_idx, r.response) for r in rows] == [(0, "same", 0, "u"), (0, "same", 1, "v"), (2, "same", 0, "w")]
    pair = benchmarks.compare_benchmark_models(back).first()
    assert (pair.model_path_a, pair.position_b, pair.speed_change_pct) == ("x/same", 2, pytest.approx(50.0))


def test_comparison_of_statistics_by_a_given_order(spark, documents):
    rows = spark.createDataFrame([run("z", 0, 1.0, 1), run("a", 0, 1.0, 2)], RUNS)
    stats = generation_stats(rows).withColumn("at", F.when(F.col("model") == "z", 0).otherwise(1))
    assert compare_models(stats, order="at").first().model_a == "z"
    assert compare_models(stats).first().model_a == "a"


def test_report_exists_if_its_file_is_json(spark, tmp_path):
    path = str(tmp_path / "r")
    given = [("arc", '{"results": {"x": {"acc": 0.25}}}'), ("bbh", "{broken"), ("math", None), ("piqa", '{"other": 1}')]
    tables.write_reports(spark.createDataFrame(given, "task string, report string"), path)
    suite = eval_reports.suite_table(spark)
    reports = tables.read_reports(spark, path, suite.select(F.col("name").alias("task")))
    updates = spark.createDataFrame([(1, "2024-01-01 00:00:00", "done", 0.9)], "task_id long, ts string, status string, score double")
    rows = {r.name: r for r in eval_reports.task_table(suite, updates.withColumn("ts", F.to_timestamp("ts")), reports=reports).collect()}
    assert len(rows) == 16
    assert (rows["arc"].score, rows["arc"].report.exists, rows["arc"].status) == (0.25, True, "done")
    assert [rows[t].report.exists for t in ("bbh", "math", "piqa", "gsm8k")] == [False, False, True, False]
    assert rows["piqa"].score is None
