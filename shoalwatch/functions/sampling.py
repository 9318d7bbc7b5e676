"""Samples that depend on the rows and a seed, not on where the rows lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows looked for on average in the first pass, as a multiple of the sample.
_MORE = 16
_TOP = (1 << 63) - 1


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def seeded_sample(df: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The ``size`` distinct rows of the smallest seeded hashes, of all rows.

    A table with fewer distinct rows is its own sample, copies included.

    The same rows give the same sample in any order and partitioning. Only
    rows below a bound are compared, which the number of rows suggests and
    which is raised if copies leave too few distinct ones; so a pass sends
    few rows, and the driver gets ``size`` of them. Maps don't count for the
    hash.
    """
    name = next(n for n in (f"h{'_' * i}" for i in range(1, len(df.columns) + 2)) if n not in df.columns)
    columns = [F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)]
    hashed = df.withColumn(name, F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1))
    n = df.count()
    share = min(1.0, _MORE * size / n) if n else 1.0
    while True:
        rows = hashed if share == 1.0 else hashed.where(F.col(name) <= int(share * _TOP))
        found = rows.dropDuplicates([name]).orderBy(name).limit(size).drop(name).collect()
        if len(found) == size:
            return df.sparkSession.createDataFrame(found, df.schema)
        if share == 1.0:
            return df
        share = min(1.0, 64 * share)
