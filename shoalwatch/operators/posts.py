"""Small analyses of single posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def character_count(df: DataFrame, message_id: str = "message_id", text: str = "message_text", *, fudge_factor: int = 0) -> DataFrame:
    """``message_id, character_count``: characters (code points) plus a constant."""
    return df.select(F.col(message_id).alias("message_id"), (F.length(text) + fudge_factor).cast("long").alias("character_count"))


def long_message_report(counts: DataFrame, *, longer_than: int = 100) -> DataFrame:
    """Add ``is_long``."""
    return counts.withColumn("is_long", F.col("character_count") > longer_than)


def length_histogram(counts: DataFrame, *, bins: int = 50) -> DataFrame:
    """``bin, bin_start, bin_end, count`` of equal bins between least and most."""
    ends = counts.agg(F.min("character_count").alias("lo"), F.max("character_count").alias("hi"))
    width = F.greatest(F.lit(1e-9), (F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    at = F.least(F.floor((F.col("character_count") - F.col("lo")) / width), F.lit(bins - 1)).cast("long")
    joined = counts.where("character_count is not null").crossJoin(F.broadcast(ends))  # one row
    grouped = joined.groupBy(at.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    return grouped.select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), "count")


def temporal_profile(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Posts by hour of the day: ``count, time_interval_start, time_interval_end``.

    Times are ``HH:00:00`` strings. Rows without a time form one group of
    count 0 with null times, ordered first.
    """
    from shoalwatch.functions.timebins import hour_label

    grouped = df.groupBy(F.hour(ts).alias("h")).agg(F.count(ts).alias("count"))
    start, end = hour_label(F.col("h")), hour_label((F.col("h") + 1) % 24)
    null = F.col("h").isNull()
    return grouped.orderBy(F.asc_nulls_first("h")).select("count", F.when(~null, start).alias("time_interval_start"), F.when(~null, end).alias("time_interval_end"))


def temporal_labels(profile: DataFrame) -> DataFrame:
    """Bars of the profile: ``label`` (``HH:MM-HH:MM``) and ``count``."""
    return profile.select(F.concat(F.substring("time_interval_start", 1, 5), F.lit("-"), F.substring("time_interval_end", 1, 5)).alias("label"), "count")
