"""Concentration statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gini(counts: Column) -> Column:
    """Gini coefficient of an array of counts: 0 even, towards 1 concentrated.

    With counts sorted ascending and running sums C of n values it is
    (n + 1 - 2 * sum(C) / C[n]) / n. Null for an empty array.
    """
    ordered = F.array_sort(counts)
    n = F.size(counts)
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x)
    weighted = F.aggregate(F.transform(ordered, lambda x, i: x * (n - i)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((n > 0) & (total > 0), (n + 1 - 2 * weighted / total) / n)


def grouped_gini(counts: DataFrame, by: str, value: str, out: str = "gini") -> DataFrame:
    """``by, total, n, <out>``: sum, number and Gini coefficient of each group's values.

    As ``gini``, from how often each value stands. Equal values have
    neighbouring ranks, so m of them after b smaller ones add
    value * (m * (n - b) - m * (m - 1) / 2) to the sum of running sums. A
    group of whole numbers with the sum s has about the root of 2 * s
    different values, so that is what its window sorts, however many
    members it has. Null values count as none; a sum of 0 has no coefficient.
    """
    often = counts.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("c")).agg(F.count(F.lit(1)).alias("m"))
    below = F.coalesce(F.sum("m").over(Window.partitionBy(by).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = often.withColumn("b", below)
    double = lambda c: F.col(c).cast("double")
    sums = placed.groupBy(by).agg(F.sum(F.col("c") * F.col("m")).alias("total"), F.sum("m").alias("n"), F.sum(double("c") * (double("m") * double("b") + double("m") * (double("m") - 1) / 2)).alias("less"))
    weighted = double("n") * double("total") - F.col("less")
    return sums.select(by, "total", "n", F.when(F.col("total") > 0, (F.col("n") + 1 - 2 * weighted / F.col("total")) / F.col("n")).alias(out))
