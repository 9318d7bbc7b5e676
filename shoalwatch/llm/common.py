"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where the setting is absent and driver and executors are one
    process on one machine, as in tests, a temporary folder is set and used;
    on a cluster, its executors would each write to a disk of their own.
    """
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shoalwatch-")
        spark.conf.set(_KEY, found)
        atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, observed: Observation | None = None, *measures: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    ``observed`` gets ``measures`` of the rows while they are written.

    Cuts the lineage, so that a lost executor costs a re-read and not a
    recomputation. ``drop_table`` removes a table that is no longer read;
    the others go when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shoalwatch-{uuid.uuid4().hex}-{tag}"
    (df if observed is None else df.observe(observed, *measures)).write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shoalwatch_path = path
    return out


class Scratch:
    """Tables that an operator needs until its last one is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables.append(materialize(df, tag))
        return self.tables[-1]

    def clear(self) -> None:
        for table in self.tables:
            drop_table(table)
        self.tables = []


def drop_table(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``."""
    _remove(df.sparkSession, df._shoalwatch_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone at exit; the folder's owner cleans up
        return


def internal(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    mark = next(m for m in (f"__{i}" for i in range(len(taken) + 1)) if not any(n.lower() + m in taken for n in names))
    return [n + mark for n in names]


def append_columns(
    df: DataFrame,
    fields: list[tuple[str, T.DataType]],
    function: Callable[[pa.RecordBatch], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Map Arrow batches to further columns, one value per row.

    ``keep`` names the columns that pass through (all by default). A column
    of ``df`` whose name clashes with a new one is replaced.
    """
    new = {name for name, _ in fields}
    passed = [c for c in (keep or df.columns) if c not in new]
    schema = T.StructType([f for f in df.schema if f.name in passed] + [T.StructField(n, t) for n, t in fields])
    at = [df.columns.index(f.name) for f in schema if f.name in passed]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in at] + function(batch)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(mapped, schema)
