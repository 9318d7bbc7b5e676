"""Row numbers in a global order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwatch.session import written

_LOW = (1 << 33) - 1
#: Neighbours that are summed in one window.
GROUP = 4096


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Add ``name``: the row's rank from 0 by ``order``; ties in any order, which stays.

    Rows are sorted in ranges and written once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_order(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), name)


def in_order(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the row's place from 0 in the order that ``df`` has, as after ``orderBy``.

    The rows are written once. A partition's rows are numbered where they
    lie, and shifted by the sizes of the partitions before it, of which there
    is one row each.
    """
    at, part, before = (f"{name}__{x}" for x in ("at", "part", "before"))
    table = written(df.withColumn(at, F.monotonically_increasing_id()), "numbered")
    placed = table.withColumn(part, F.shiftright(at, 33))
    shifts = sums_before(placed.groupBy(part).count(), part, "count", before)
    found = placed.join(F.broadcast(shifts), part)  # one row a partition
    out = found.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit(_LOW))).drop(at, part, before)
    out._shoalwatch_folder = table._shoalwatch_folder  # for who is done with it
    return out


def sums_before(df: DataFrame, key: str, value: str, out: str, *, group: int = GROUP) -> DataFrame:
    """``key, out``: the sum of ``value`` over all smaller keys, which are distinct whole numbers from 0.

    Keys are summed in groups of ``group`` neighbours, these in groups again,
    and so on until one group is left; then the sums come down, each within
    its group. So no window sees more than ``group`` rows. How many levels
    there are follows from the largest key.
    """
    levels = [written(df.select(F.col(key).cast("long").alias("k"), F.col(value).cast("long").alias("v")), "sums")]
    top = levels[0].agg(F.max("k")).first()[0] or 0
    while top >= group:
        levels.append(levels[-1].groupBy(F.floor(F.col("k") / group).alias("k")).agg(F.sum("v").alias("v")))
        top //= group
    above = None
    for level in reversed(levels):
        own = level.withColumn("g", F.floor(F.col("k") / group))
        order = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        own = own.withColumn("b", F.coalesce(F.sum("v").over(order), F.lit(0)))
        if above is not None:
            own = own.join(above.select(F.col("k").alias("g"), F.col("b").alias("more")), "g").withColumn("b", F.col("b") + F.col("more"))
        above = own.select("k", "b")
    return above.select(F.col("k").cast(dict(df.dtypes)[key]).alias(key), F.col("b").alias(out))
