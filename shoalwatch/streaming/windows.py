"""Windowed analyses over streams, with watermarks for late posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwatch.operators.hashtags import extract_hashtags


def hourly_counts(stream: DataFrame, ts: str = "timestamp", *, late: str = "1 hour") -> DataFrame:
    """Posts per clock hour, final once the watermark has passed."""
    hours = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"))
    return hours.agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), "count")


def hashtag_counts(stream: DataFrame, text: str = "text", ts: str = "timestamp", *, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Uses of each hashtag per tumbling window aligned to the epoch."""
    tags = stream.withWatermark(ts, late).select(F.col(ts), F.explode(extract_hashtags(F.col(text))).alias("hashtag"))
    return tags.groupBy(F.window(ts, size), "hashtag").agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), "hashtag", "count")


def active_users(stream: DataFrame, user: str = "user_id", ts: str = "timestamp", *, size: str = "15 minutes", step: str = "5 minutes", late: str = "15 minutes") -> DataFrame:
    """Posts of each user per sliding window: the streamable part of co-posting."""
    users = stream.withWatermark(ts, late).groupBy(F.window(ts, size, step), user)
    return users.agg(F.count(F.lit(1)).alias("posts")).select(F.col("window.start").alias("start"), F.col(user).alias("user_id"), "posts")
