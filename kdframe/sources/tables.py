"""Datasets, reports and saved sessions on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kdframe.operators.eval_prompts import parse_suite
from kdframe.operators.eval_scoring import first_result, pick_score

PART_ROWS = 1000


def load_split(
    spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet", column: str = "split"
) -> DataFrame:
    """A named dataset, one split. Where splits are partition directories, others are not read."""
    data = spark.read.format(fmt).load(path)
    return data if split is None else data.where(F.col(column) == split)


def load_subset(
    spark: SparkSession, root: str, subset: str, split: str | None = None, fmt: str = "parquet", tasks: int | None = None
) -> DataFrame:
    """A sub-directory of a dataset; ``tasks`` asks for that many partitions."""
    data = load_split(spark, f"{root.rstrip('/')}/{subset.strip('/')}", split, fmt)
    return data.repartition(tasks) if tasks else data


def text_column(df: DataFrame, field: str, keep: Sequence[str] = ()) -> DataFrame:
    """The one text column used for training."""
    return df.select(*keep, F.col(field).alias("text"))


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    return parse_suite(spark.read.text(path))


def read_reports(spark: SparkSession, path: str, tasks: DataFrame) -> DataFrame:
    """Score of every task from its report, and whether that exists as readable JSON.

    A report is a file ``<task>.json``, or the one file in a folder ``task=<task>`` as ``write_reports`` makes it.
    """
    files = spark.read.text(path, wholetext=True)
    by_name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    named = F.col("task").cast("string") if "task" in files.columns else by_name
    files = files.select(named.alias("task"), "value")
    parsed = files.withColumn("exists", F.try_parse_json("value").isNotNull())
    scored = parsed.withColumn("score", pick_score(first_result(F.col("value")))).drop("value")
    return tasks.join(scored, "task", "left").na.fill({"exists": False})


def write_reports(reports: DataFrame, path: str) -> None:
    """One file per task from ``task`` and the JSON text ``report``, in a folder ``task=<task>``."""
    files = reports.select("task", F.coalesce("report", F.lit("")).alias("value"))
    files.repartition("task").write.mode("errorifexists").partitionBy("task").text(path)


def save_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Prepared data by split, spread over tasks so that a large split is many files."""
    df.write.mode("errorifexists").partitionBy(split).parquet(path)


def nest_runs(runs: DataFrame, fields: Sequence[str], index: str = "prompt_idx", rows: int = PART_ROWS) -> DataFrame:
    """Benchmark runs as one document per model with a ``responses`` array.

    A model with more than ``rows`` responses becomes several documents numbered by ``part``, so no
    model is ever gathered whole.
    """
    response = F.struct(index, *fields)
    return (
        runs.groupBy("model", F.floor(F.col(index) / rows).alias("part"))
        .agg(F.sort_array(F.collect_list(response)).alias("responses"))
    )


def write_runs(runs: DataFrame, path: str, fields: Sequence[str]) -> None:
    nest_runs(runs, fields).write.mode("errorifexists").json(path)


def read_runs(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Nested benchmark documents back to one row per response.

    ``multi_line`` reads a single JSON array, the layout of small hand-made files.
    """
    documents = spark.read.schema(schema).json(path, multiLine=multi_line)
    return documents.select("model", F.explode("responses").alias("_r")).select("model", "_r.*")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def nest_sessions(messages: DataFrame, chat: str = "chat_id", order: str = "turn", rows: int = PART_ROWS) -> DataFrame:
    """Chat sessions as ``{id, part, messages: [{role, content, timestamp}]}`` documents."""
    one = F.struct(order, "role", "content", iso_time(F.col("ts")).alias("timestamp"))
    gathered = F.sort_array(F.collect_list(one))
    return messages.groupBy(F.col(chat).cast("string").alias("id"), F.floor(F.col(order) / rows).alias("part")).agg(
        F.transform(gathered, lambda m: F.struct(m["role"], m["content"], m["timestamp"])).alias("messages")
    )


def chat_id(title: Column, started: Column) -> Column:
    """Name of a saved chat: its title, else its start time."""
    return F.coalesce(F.nullif(title, F.lit("")), F.date_format(started, "yyyyMMdd_HHmmss"))


# ids are titles or times, so they are text
SESSION_SCHEMA = "id string, part long, messages array<struct<role:string,content:string,timestamp:string>>"


def write_sessions(messages: DataFrame, path: str, chat: str = "chat_id") -> None:
    nest_sessions(messages, chat).write.mode("errorifexists").json(path)


def read_sessions(spark: SparkSession, path: str, rows: int = PART_ROWS) -> DataFrame:
    """Saved sessions as one row per message, with parsed timestamps."""
    documents = spark.read.schema(SESSION_SCHEMA).json(path)
    return documents.select("id", "part", F.posexplode("messages").alias("_at", "_m")).select(
        F.col("id").alias("chat_id"),
        (F.col("part") * rows + F.col("_at")).alias("turn"),
        "_m.role",
        "_m.content",
        F.to_timestamp("_m.timestamp").alias("ts"),
    )


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new version directory; the parquet commit marker makes it visible as a whole."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """The newest committed version, optionally among those before ``below``."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = [
        int(s.getPath().getName().split("=")[1])
        for s in files.listStatus(base)
        if s.getPath().getName().startswith("version=")
        and files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    if below is not None:
        versions = [v for v in versions if v < below]
    if not versions:
        raise FileNotFoundError(f"no committed snapshot below {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/version={max(versions)}")
