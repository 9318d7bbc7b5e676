"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shoalwatch.llm.common import drop_table, materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and checksum, taken while writing."""
    seen = Observation()
    table = materialize(edges, "edges", seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    return table, (seen.get["n"], seen.get["s"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge, components by smallest node.

    Alternates large-star and small-star steps until nothing changes; the
    rounds grow with the logarithm of a component's length. Edges with a
    null end and loops are left out; repeated edges count once. Each round
    is written to the shared folder and the one before deleted.
    """
    now, state = _written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")).distinct())
    while state[0]:
        before, old = state, now
        now, state = _written(_small_star(_large_star(old)))
        drop_table(old)
        if state == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
