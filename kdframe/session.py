"""Session construction and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "kdframe", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches. On a cluster, use the session the cluster provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, and so see the same disk."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is set only when the session names none and runs in one local process.
    On a cluster, where executors and driver share no local disk, a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kdframe-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, in one folder per application."""
    return f"{shared_dir(spark).rstrip('/')}/kdframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder, so that lost executors cost no recomputation.

    The shuffle files that it took go as soon as the table is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Remove the files of a table of ``materialize`` that nothing will read again."""
    spark = table.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/kdframe/{spark.sparkContext.applicationId}/".removeprefix("file:").lstrip("/")
    for file in table.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if own in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_fits(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a counted, small table; leave a larger one to the optimizer's shuffle joins."""
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
