"""Session settings that the analyses expect."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHARED = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(name: str = "shoalwatch", **settings: str) -> SparkSession:
    """A session with wall-clock times in UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's name in the folder all executors share; it goes when the process ends.

    Without ``spark.checkpoint.dir``, only local sessions have such a folder.
    """
    shared = spark.conf.get(_SHARED, None) or spark.sparkContext.getConf().get(_SHARED, None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {_SHARED} to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="shoalwatch-")
        spark.conf.set(_SHARED, shared)
        atexit.register(shutil.rmtree, shared, True)
    folder = f"{shared.rstrip('/')}/shoalwatch-{uuid.uuid4().hex}-{tag}"
    atexit.register(remove, spark, folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    except Exception:  # the JVM is gone at exit; the folder's owner cleans up
        return


def written(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, computed once and read as often as needed.

    It has a folder for each value of ``by``. The shuffles that made it are
    deleted when it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    folder, before = scratch(spark, tag), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._shoalwatch_folder = folder
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of ``written`` that is no longer read."""
    remove(df.sparkSession, df._shoalwatch_folder)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the table has fewer files than there are cores.

    A small table is often one file of one row group, which one task would
    read and work on alone. Tables of more files pass as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
