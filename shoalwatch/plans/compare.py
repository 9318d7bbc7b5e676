"""Tables side by side: stacking with common types, differences, display, batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def stacked(tables: list[DataFrame], *, fill: bool = False) -> DataFrame:
    """Rows of all tables, matched by column name, with the wider type of each column.

    Columns that a table lacks raise, or are null if ``fill``.
    """
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=fill)
    return out


def differing_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, differing`` of rows that don't agree: the columns with other values.

    Nulls agree with nulls. Rows that one side lacks differ in ``keys``. Both
    tables have the same columns, and keys that are unique.
    """
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    rest = [c for c in left.columns if c not in keys]
    side = lambda df, name: df.select(F.struct(*keys).alias(f"{name}_key"), F.struct(F.lit(True).alias("there"), *rest).alias(name))
    joined = side(left, "l").join(side(right, "r"), F.col("l_key").eqNullSafe(F.col("r_key")), "full")
    joined = joined.select(F.coalesce("l_key", "r_key").alias("key"), "l", "r")
    missing = F.col("l.there").isNull() | F.col("r.there").isNull()
    other = [F.when(~F.col("l")[c].eqNullSafe(F.col("r")[c]), F.lit(c)) for c in rest]
    differing = F.when(missing, F.array(*[F.lit(k) for k in keys])).otherwise(F.filter(F.array(F.lit(None).cast("string"), *other), lambda c: c.isNotNull()))
    return joined.select("key.*", differing.alias("differing")).where(F.size("differing") > 0)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, for display; nested ones as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cell = lambda f: F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")
    return df.select([cell(f).alias(f.name) for f in df.schema])


def record_batches(df: DataFrame, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The table as Arrow batches of ``rows`` rows, one partition on the driver at a time."""
    schema = to_arrow_schema(df.schema)
    source = df.toLocalIterator(prefetchPartitions=False)
    while part := list(islice(source, rows)):
        yield pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in part], schema=schema)
