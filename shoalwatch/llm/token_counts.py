"""Exact length histogram of a corpus and what its suffix sums answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalwatch.llm import bpe
from shoalwatch.llm.common import materialize

#: Lengths that share one block of the two-level running sums.
BLOCK = 1024


def length_histogram(df: DataFrame, text: str = "text", *, ranks_path: str = bpe.RANKS) -> DataFrame:
    """Documents by encoded length: ``n_tokens, n_docs``.

    Null and empty texts have length 0; repeated rows count each time; an
    empty table has an empty histogram. Other columns are not read.
    """
    counted = bpe.with_token_count(df.select(text), text, ranks_path=ranks_path, keep=[text]).select("n_tokens")
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, what a context limit of that length gives.

    Columns: ``n_tokens`` (the length and limit), ``n_docs``, ``docs_at_least``,
    ``docs_up_to``, ``total_tokens`` (all documents), ``tokens_at_least``
    (of documents that long), ``truncated_total`` (tokens left if each
    document is cut to the limit), ``cut_docs``, ``quantile`` (share of
    documents up to this length).

    The sums run on two levels, blocks of lengths and lengths in a block:
    no task gets more than ``BLOCK`` lengths or one row per block. The
    histogram is written first, as both levels read it.
    """
    histogram = materialize(histogram, "lengths")
    blocks = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    tops = (
        blocks.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
            F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
            F.sum("d").over(whole).alias("all_docs"),
            F.sum("t").over(whole).alias("total_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.join(tops, "block")
        .withColumn("docs_at_least", F.col("docs_after") + F.sum("n_docs").over(inside))
        .withColumn("tokens_at_least", F.col("tokens_after") + F.sum("tokens").over(inside))
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
            "total_tokens",
            "tokens_at_least",
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
            (F.col("docs_at_least") - F.col("n_docs")).alias("cut_docs"),
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        )
    )


def truncated_totals(sums: DataFrame, limits: DataFrame, limit: str = "limit") -> DataFrame:
    """``limit, truncated_total`` for any limits, whether a length occurs or not.

    A limit lies in the gap under the next length L that occurs: each of the
    documents at least that long loses L - limit more than at L. Beyond the
    longest document nothing is cut. The join is on a stated set of limits.
    """
    asked = limits.select(F.col(limit).cast("long").alias("limit")).distinct()
    # the limits, a stated set, go to the lengths; lengths aren't bounded
    reached = sums.join(F.broadcast(asked.where("limit is not null")), F.col("n_tokens") >= F.col("limit"))
    found = reached.groupBy("limit").agg(F.min_by(F.struct("n_tokens", "docs_at_least", "truncated_total"), "n_tokens").alias("up"))
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"))
    return asked.join(found, "limit", "left").crossJoin(F.broadcast(total)).select(
        "limit",
        F.coalesce(F.col("up.truncated_total") - (F.col("up.n_tokens") - F.col("limit")) * F.col("up.docs_at_least"), F.col("total")).alias("truncated_total"),
    )
