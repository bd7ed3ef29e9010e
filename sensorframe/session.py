"""Session defaults. On a cluster the deployment's own settings win; these suit tests and benches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "sensorframe") -> SparkSession:
    """A local session for tests and benches, with time zone pinned to UTC and AQE on."""
    cores = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one in ``spark.checkpoint.dir``.

    Only a local session, whose driver is the sole executor, may go without the setting; it gets a new folder
    of its own. A cluster without the setting is an error, as its executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _own_folders[context.applicationId]


# With this setting the shuffle files of a query go when it ends, not when the driver's JVM happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, compression: str = "zstd", lean: bool = False, path: str | None = None) -> DataFrame:
    """Write a table used more than once to the shared folder and go on from there.

    Later stages start from stored data: nothing is computed twice and a lost executor takes nothing along.
    The table goes when the driver's JVM ends. ``lean``: the shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = path or _path(spark)
    before = spark.conf.get(SHUFFLES_GO, None)
    if lean:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if lean:
            spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(df: DataFrame) -> Iterator[DataFrame]:
    """``stored``, lean, for the time of a block only: the table goes when the block ends.

    What is made of the table in the block has to be stored there as well.
    """
    spark = df.sparkSession
    path = _path(spark)
    try:
        yield stored(df, lean=True, path=path)
    finally:
        files, where = _files(spark, path)
        files.delete(where, True)
