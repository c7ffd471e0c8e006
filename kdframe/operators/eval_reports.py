"""Run progress, generation statistics and two-model comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: (task, shots, kind) of the full suite
SUITE = [
    ("hellaswag", 0, "mc"), ("arc", 0, "mc"), ("piqa", 0, "mc"), ("commonsense_qa", 0, "mc"),
    ("winogrande", 0, "mc"), ("openbook_qa", 0, "mc"), ("mmlu_pro", 0, "mmlu"),
    ("nq_open_heldout", 0, "gen_small"), ("triviaqa_heldout", 0, "gen_small"), ("gsm8k", 5, "gsm8k"),
    ("math", 4, "math"), ("humaneval", 0, "humaneval"), ("ifeval", 0, "gen_small"),
    ("mt_bench", 0, "gen_small"), ("openrewrite_eval", 0, "gen_small"), ("bbh", 3, "bbh"),
]


def suite_table(spark: SparkSession) -> DataFrame:
    """The suite before a run: 16 pending tasks."""
    rows = [(i, name, shots, kind, "pending") for i, (name, shots, kind) in enumerate(SUITE)]
    return spark.createDataFrame(rows, "task_id long, name string, shots int, kind string, status string")


def humantime(seconds: Column) -> Column:
    """``1h 2m 3s`` with leading zero parts left out; NULL for no time."""
    whole = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return (
        F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest))
        .when(whole.isNotNull(), F.format_string("%ds", rest))
    )


def latest_state(updates: DataFrame, by: Sequence[str] = ("task_id",), time: str = "ts") -> DataFrame:
    """Last reported state of every task."""
    rest = [c for c in updates.columns if c not in by]
    order = F.struct(time, *[c for c in rest if c != time])
    return updates.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*by, "_s.*")


def task_table(suite: DataFrame, updates: DataFrame, time: str = "ts", reports: DataFrame | None = None) -> DataFrame:
    """Current row of every suite task: status, score, runtime so far and report file.

    Updates are reduced to one row per task before they meet the 16-row suite. With ``reports`` (rows of
    ``read_reports``, named like the suite's tasks), the score is the report's, and the report exists if
    its file is readable JSON; without them, both follow the last update.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    spans = updates.groupBy("task_id").agg(
        ((micros(F.max(time)) - micros(F.min(time))) / 1e6).alias("_span"), F.max_by("score", time).alias("score"),
        F.max_by("status", time).alias("_status"),
    )
    current = suite.join(spans, "task_id", "left").withColumn("_exists", F.col("score").isNotNull())
    if reports is not None:
        read = reports.select(F.col("task").alias("name"), F.col("score").alias("_score"), F.col("exists").alias("_read"))
        current = current.join(read, "name", "left").withColumns(
            {"score": F.col("_score"), "_exists": F.coalesce("_read", F.lit(False))}
        )
    return current.select(
        "task_id",
        "name",
        "shots",
        F.coalesce("_status", "status").alias("status"),
        "score",
        humantime(F.col("_span")).alias("runtime"),
        F.struct(F.concat("name", F.lit(".json")).alias("path"), F.col("_exists").alias("exists")).alias("report"),
    )


def progress(states: DataFrame, updates: DataFrame, time: str = "ts") -> DataFrame:
    """Tasks done, total and elapsed time of a run."""
    counts = states.agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count(F.lit(1)).alias("total")
    )
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = updates.agg(((micros(F.max(time)) - micros(F.min(time))) / 1e6).alias("_span"))
    return counts.withColumn("elapsed_sec", F.floor(span.scalar())).withColumn(
        "elapsed_human", humantime(F.col("elapsed_sec"))
    )


def tokens_per_second(tokens: Column, time: Column) -> Column:
    """0 when no time passed."""
    return F.when(time > 0, tokens / time).otherwise(F.lit(0.0))


def with_speed(runs: DataFrame) -> DataFrame:
    return runs.withColumn(
        "tokens_per_second", tokens_per_second(F.col("tokens_generated"), F.col("generation_time"))
    )


def generation_stats(runs: DataFrame, by: Sequence[str] = ("model",), failed: str | None = None) -> DataFrame:
    """Mean time, mean tokens and overall speed (a ratio of sums) per model; failed models are skipped."""
    time, tokens = F.sum("generation_time"), F.sum("tokens_generated")
    bad = F.coalesce(F.max(F.col(failed).cast("int")), F.lit(0)) if failed is not None else F.lit(0)
    stats = runs.groupBy(*by).agg(
        bad.alias("_bad"),
        F.count(F.lit(1)).alias("responses"),
        F.avg("generation_time").alias("avg_generation_time"),
        F.avg("tokens_generated").alias("avg_tokens_generated"),
        tokens_per_second(tokens, time).alias("avg_tokens_per_second"),
    )
    return stats.where("_bad = 0").drop("_bad")


def compare_models(
    stats: DataFrame, first: str | None = None, second: str | None = None, order: str = "model"
) -> DataFrame:
    """Two models side by side, by default the first and the last by ``order``; the same model twice gives no row.

    ``stats`` has one row per model, so the window over all of it is small.
    """
    models = Window.partitionBy()
    picked = stats.withColumn("_first", F.lit(first) if first else F.min_by("model", order).over(models)).withColumn(
        "_second", F.lit(second) if second else F.max_by("model", order).over(models)
    )
    sides = [
        F.max(F.when(F.col("model") == F.col(chosen), F.col(c))).alias(f"{c}_{suffix}")
        for chosen, suffix in (("_first", "a"), ("_second", "b"))
        for c in stats.columns
    ]
    change = (F.try_divide("avg_tokens_per_second_b", "avg_tokens_per_second_a") - 1) * 100
    return (
        picked.where("_first <> _second")
        .agg(*sides)
        .where("model_a IS NOT NULL AND model_b IS NOT NULL")
        .withColumn("speed_change_pct", change)
    )


def aligned_responses(runs: DataFrame, first: str, second: str, index: str = "prompt_idx") -> DataFrame:
    """Responses of two models to the same prompt, by index; every row of the first model is kept."""
    columns = [c for c in runs.columns if c not in ("model", index)]

    def side(model: str, suffix: str) -> DataFrame:
        return runs.where(F.col("model") == model).select(
            index, *[F.col(c).alias(f"{c}_{suffix}") for c in columns]
        )

    return side(first, "a").join(side(second, "b"), index, "left")
