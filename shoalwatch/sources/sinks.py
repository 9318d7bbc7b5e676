"""Export of result tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwatch.functions.numbering import in_order, numbered
from shoalwatch.session import forget
from shoalwatch.sources.csv import write_text
from shoalwatch.sources.excel import write_sheets

FORMATS = ("parquet", "csv", "xlsx", "json")
#: Rows of the smallest chunk.
LEAST_CHUNK = 100
_PLACE, _CHUNK = "place__of_row", "chunk__of_row"


@dataclass(frozen=True)
class ExportPolicy:
    """``chunk_rows`` of None writes one file."""

    chunk_rows: int | None = None

    def __post_init__(self):
        if self.chunk_rows is not None and self.chunk_rows < LEAST_CHUNK:
            raise ValueError(f"a chunk has at least {LEAST_CHUNK} rows")


def export_name(output_id: str, secondary_id: str | None = None) -> str:
    """File name of an output, without suffix."""
    if secondary_id is None or secondary_id == output_id:
        return output_id
    return f"{secondary_id}__{output_id}"


def human_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename declared columns; the others pass through."""
    return df.select([F.col(c).alias(names.get(c, c)) for c in df.columns])


def flat(df: DataFrame) -> bool:
    return not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema)


def write(df: DataFrame, path: str, kind: str) -> str:
    """Write one table to ``<path>.<kind>``. Nested columns need JSON or parquet.

    CSV, JSON (one array of rows) and XLSX are one file each, written by one
    task, in the order of ``df``; ``export`` writes large tables in chunks by
    many. Parquet is a folder of files.
    """
    _allow(df, kind)
    target = f"{path}.{kind}"
    if kind == "parquet":
        df.write.mode("overwrite").parquet(target)
    elif kind == "xlsx":
        write_sheets(df.coalesce(1), [target])
    else:
        _write_files(df, [target], kind)
    return target


def _allow(df: DataFrame, kind: str) -> None:
    if kind not in FORMATS:
        raise ValueError(f"format {kind!r} is none of {FORMATS}")
    if kind in ("csv", "xlsx") and not flat(df):
        raise ValueError(f"{kind} can't hold nested columns")


def _as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one JSON array from the rows of one task."""
    mark = "["
    for batch in batches:
        lines = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([(mark if i == 0 else ",") + x for i, x in enumerate(lines)], pa.string())], names=["value"])
        mark = "," if lines else mark
    yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"], pa.string())], names=["value"])


def _write_files(df: DataFrame, targets: list[str], kind: str, chunk: str | None = None) -> None:
    """One file for each target, all of one job, in place at once or not at all.

    ``df`` has its chunk's number in ``chunk``, rows of a chunk in one
    partition and in order; without it, all rows go to the one target. The
    tasks write to a folder beside the targets, where Spark's commit leaves
    nothing of a task that failed; then the files are renamed. If the job
    fails, the folder goes and no target has changed.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    make = lambda *parts: jvm.org.apache.hadoop.fs.Path(*parts)
    staged = make(make(targets[0]).getParent(), f"_{uuid.uuid4().hex}")
    fs = staged.getFileSystem(conf)
    try:
        rows = df if chunk else df.coalesce(1)
        if kind == "json" and not chunk:
            rows = rows.select(_as_json(df).alias("value")).mapInArrow(_array_lines, "value string")
        writer = rows.write.partitionBy(chunk) if chunk else rows.write
        if kind == "csv":
            # by default Spark's writer cuts white space and control characters off the ends of fields
            writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(staged.toString())
        elif kind == "json":
            writer.text(staged.toString())
        else:
            writer.parquet(staged.toString())
        moves = []
        for k, target in enumerate(targets):
            folder = make(staged, f"{chunk}={k}") if chunk else staged
            files = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
            if len(files) > 1:
                raise RuntimeError(f"{len(files)} tasks wrote to {target}")
            if not files:  # a table without rows may have no task
                files = [make(folder, "part-empty")]
                with_text = fs.create(files[0])
                with_text.write(bytearray(("[]" if kind == "json" else write_text([df.columns])).encode()))
                with_text.close()
            moves.append((files[0], make(target)))
        for source, target in moves:
            fs.delete(target, True)
            if not fs.rename(source, target):
                raise RuntimeError(f"{target} can't be put in place")
    finally:
        fs.delete(staged, True)


def with_chunks(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """Add ``chunk`` from 0: consecutive ``rows`` rows in the given order.

    Rows are numbered where a range partitioning puts them, so no single
    task sees all rows.
    """
    return numbered(df, "chunk", *order).withColumn("chunk", F.floor(F.col("chunk") / rows).cast("long"))


def export(df: DataFrame, path: str, kind: str, policy: ExportPolicy = ExportPolicy(), *, order: list[str] | None = None) -> list[str]:
    """Write in one file, or in chunks ``<path>_<k>.<kind>``; returns the paths.

    Rows are in the order of ``df``, or by ``order``. A table that fits one
    chunk gives one plain file; an empty table with a chunk size gives none. All chunks are written by one job, a chunk by one
    task, and come into place together.
    """
    _allow(df, kind)
    if policy.chunk_rows is None:
        return [write(df, path, kind)]
    size = policy.chunk_rows
    placed = numbered(df, _PLACE, *order) if order else in_order(df, _PLACE)
    n = placed.count()
    if n == 0:
        return []
    chunks = -(-n // size)
    targets = [f"{path}.{kind}"] if chunks == 1 else [f"{path}_{k}.{kind}" for k in range(chunks)]
    if kind == "parquet" and chunks == 1:
        return [write(df, path, kind)]
    rows = placed.withColumn(_CHUNK, F.floor(F.col(_PLACE) / size).cast("long"))
    if kind == "json":
        last = (F.col(_PLACE) == n - 1) | ((F.col(_PLACE) + 1) % size == 0)
        line = F.concat(F.when(F.col(_PLACE) % size == 0, "[").otherwise(","), _as_json(df), F.when(last, "]").otherwise(""))
        rows = rows.select(_CHUNK, _PLACE, line.alias("value"))
    parts = min(chunks, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartition(parts, _CHUNK).sortWithinPartitions(_CHUNK, _PLACE).drop(_PLACE)
    if kind == "xlsx":
        write_sheets(dealt, targets, _CHUNK)
    else:
        _write_files(dealt, targets, kind, _CHUNK)
    forget(placed)
    return targets
