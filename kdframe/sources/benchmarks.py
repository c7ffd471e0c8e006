"""Benchmark documents: one per model, in the order in which the models were run, with their responses nested.

A document has the model's name, path, number of parameters and size, the averages of its run, and
its responses in prompt order. A model of many responses becomes several documents numbered by
``part``, which repeat the model's fields, so that no model is gathered whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kdframe.operators.eval_reports import generation_stats, tokens_per_second
from kdframe.session import broadcast_if_fits
from kdframe.sources.tables import PART_ROWS

MAX_MODELS = 100_000
RESPONSE_FIELDS = ("prompt", "response", "generation_time", "tokens_generated", "tokens_per_second")
MODEL_FIELDS = (
    "model_name", "model_path", "avg_generation_time", "avg_tokens_generated", "avg_tokens_per_second",
    "total_params", "model_size_gb",
)

#: ``position`` and ``part`` are missing in files that hold all models in one array.
DOCUMENT_SCHEMA = (
    "position long, part long, model_name string, model_path string, responses array<struct<prompt_idx:long,prompt:string,"
    "response:string,generation_time:double,tokens_generated:long,tokens_per_second:double>>, avg_generation_time double, "
    "avg_tokens_generated double, avg_tokens_per_second double, total_params long, model_size_gb double"
)


def benchmark_documents(runs: DataFrame, models: DataFrame, failed: str | None = None, rows: int = PART_ROWS) -> DataFrame:
    """Documents of ``runs`` (``model``, ``prompt_idx`` and what was generated) and ``models``.

    ``models`` has one row per model: ``model``, ``position``, ``model_path``, ``total_params`` and
    ``model_size_gb``. Models that failed, or have no responses, have no document. The responses are
    shuffled once; what is known of a model is joined to its finished documents.
    """
    speed = tokens_per_second(F.col("tokens_generated"), F.col("generation_time"))
    response = F.struct("prompt_idx", *RESPONSE_FIELDS)
    nested = (
        runs.withColumn("tokens_per_second", speed)
        .groupBy("model", F.floor(F.col("prompt_idx") / rows).alias("part"))
        .agg(F.sort_array(F.collect_list(response)).alias("responses"))
    )
    known = models.join(generation_stats(runs, failed=failed).drop("responses"), "model")
    return (
        nested.join(broadcast_if_fits(known, MAX_MODELS), "model")
        .withColumnRenamed("model", "model_name")
        .select("position", "part", "model_name", "model_path", "responses", *MODEL_FIELDS[2:])
    )


def write_benchmark(documents: DataFrame, path: str) -> None:
    documents.write.mode("errorifexists").json(path)


def read_benchmark(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Documents from storage.

    ``array`` reads a file that holds one JSON array of models; a document's position is then its
    place in the array. Such a file is one value, so it suits small files only.
    """
    if not array:
        return spark.read.schema(DOCUMENT_SCHEMA).json(path)
    whole = spark.read.text(path, wholetext=True)
    models = F.from_json("value", f"array<struct<{DOCUMENT_SCHEMA}>>")
    listed = whole.select(F.posexplode(models).alias("_at", "_m")).select("_at", "_m.*")
    return listed.withColumns(
        {"position": F.col("_at").cast("long"), "part": F.coalesce("part", F.lit(0).cast("long"))}
    ).drop("_at")


def benchmark_models(documents: DataFrame) -> DataFrame:
    """One row per model: ``position`` and the model's fields."""
    return documents.groupBy("position").agg(
        F.min(F.struct("part", *MODEL_FIELDS)).alias("_m")
    ).select("position", *(f"_m.{c}" for c in MODEL_FIELDS))


def benchmark_responses(documents: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """One row per response. Without an index of its own, a response has its place in the document."""
    exploded = documents.select("position", "part", "model_name", F.posexplode("responses").alias("_at", "_r"))
    return exploded.select(
        "position",
        "model_name",
        F.coalesce("_r.prompt_idx", F.col("part") * rows + F.col("_at")).alias("prompt_idx"),
        *(f"_r.{c}" for c in RESPONSE_FIELDS),
    )


def compare_benchmark_models(
    documents: DataFrame, first: int | None = None, second: int | None = None, fields: Sequence[str] = MODEL_FIELDS
) -> DataFrame:
    """The models at two positions side by side, by default the first and the last of the documents.

    Columns end in ``_a`` and ``_b``; ``speed_change_pct`` is null if the first has no speed. The same
    position twice, or one without a document, gives no row.
    """
    models = benchmark_models(documents)
    model = F.struct("position", *fields)

    def chosen(position: int | None, end: Column) -> Column:
        return end if position is None else F.max(F.when(F.col("position") == position, model))

    pair = models.agg(chosen(first, F.min(model)).alias("a"), chosen(second, F.max(model)).alias("b"))
    sides = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("position", *fields)]
    change = (F.try_divide("b.avg_tokens_per_second", "a.avg_tokens_per_second") - 1) * 100
    return pair.where("a.position <> b.position").select(*sides, change.alias("speed_change_pct"))
