"""Hashtag concentration over time windows, and its drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwatch.functions.stats import grouped_gini
from shoalwatch.functions.timebins import utc_wall_clock, with_rolling_mean, with_tumbling
from shoalwatch.session import written

#: Java's \S with (?U) ends a tag at any Unicode white space.
HASHTAG = r"(?U)#\S+"


def extract_hashtags(text: Column) -> Column:
    """Array of all hashtags of a text, case and punctuation kept."""
    return F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(0))


def tagged_posts(df: DataFrame, user: str = "user_id", text: str = "text", ts: str = "timestamp") -> DataFrame:
    """``user_id, ts, hashtags`` of the posts that have a hashtag.

    ``text`` may also be an array of tags. String times are parsed; what
    doesn't parse is null. Times with a zone become wall clock in UTC.
    """
    kinds = dict(df.dtypes)
    when = utc_wall_clock(F.col(f"`{ts}`"), kinds[ts])
    tags = F.col(text) if kinds[text].startswith("array") else extract_hashtags(F.col(text))
    return df.select(F.col(user).alias("user_id"), when.alias("ts"), tags.alias("hashtags")).where(F.size("hashtags") > 0)


def window_tags(posts: DataFrame, unit: str = "hour", amount: int = 1) -> DataFrame:
    """``timewindow_start, user_id, ts, hashtag``: one row per use of a tag.

    Windows start at the earliest tagged post; posts without a time are left out.
    """
    binned = with_tumbling(posts.where("ts is not null"), "ts", unit, amount)
    return binned.select("timewindow_start", "user_id", "ts", F.explode("hashtags").alias("hashtag"))


def concentration(uses: DataFrame) -> DataFrame:
    """``timewindow_start, count, n_hashtags, gini, gini_smooth`` per window with data.

    Uses are counted by window and tag, and windows see how often each count
    stands: a hot tag costs one row, and so do all tags that are used as
    often. ``gini_smooth`` is the mean of three neighbouring windows that
    exist, null at both ends.
    """
    per_tag = uses.groupBy("timewindow_start", "hashtag").agg(F.count(F.lit(1)).alias("c"))
    windows = written(grouped_gini(per_tag, "timewindow_start", "c"), "windows")
    windows = windows.select("timewindow_start", F.col("total").alias("count"), F.col("n").alias("n_hashtags"), "gini")
    return with_rolling_mean(windows, "gini", "timewindow_start", "gini_smooth")


def hashtag_analysis(df: DataFrame, user: str = "user_id", text: str = "text", ts: str = "timestamp", *, unit: str = "hour", amount: int = 1, lists: bool = True) -> DataFrame:
    """The full table, with the lists of users and tags, aligned and in time order.

    ``timewindow_start`` is a string ``yyyy-MM-dd HH:mm:ss``. Without
    ``lists`` no window's uses are gathered; ``window_tags`` has them as
    rows. Raises if no post has a hashtag.
    """
    posts = tagged_posts(df, user, text, ts)
    if posts.isEmpty():
        raise ValueError("no post holds a hashtag")
    uses = window_tags(posts, unit, amount)
    out = concentration(uses).drop("n_hashtags")
    if lists:
        pairs = uses.groupBy("timewindow_start").agg(F.array_sort(F.collect_list(F.struct("ts", "user_id", "hashtag"))).alias("p"))
        out = pairs.select("timewindow_start", F.col("p.user_id").alias("users"), F.col("p.hashtag").alias("hashtags")).join(out, "timewindow_start")
    return out.orderBy("timewindow_start").withColumn("timewindow_start", F.date_format("timewindow_start", "yyyy-MM-dd HH:mm:ss"))


def default_window(windows: DataFrame) -> DataFrame:
    """The middle window, row n // 2 + 1 by start: what a view shows first.

    The order goes over the aggregated windows, not over the uses.
    """
    order = Window.orderBy("timewindow_start")
    placed = windows.select("timewindow_start", F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return placed.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("timewindow_start")


def window_end(start, unit: str, amount: int) -> Column:
    """End of a window of the declared bin size, whatever window comes next."""
    step = {"year": (amount * 12, 0), "month": (amount, 0)}.get(unit)
    if step:
        return start + F.make_ym_interval(F.lit(0), F.lit(step[0]))
    return start + F.expr(f"interval {amount} {unit}")


def window_share(uses: DataFrame, window: str | None = None) -> DataFrame:
    """``timewindow_start, hashtag, count, n_users, percent`` of each window's uses."""
    rows = uses if window is None else uses.where(F.col("timewindow_start") == F.lit(window).cast("timestamp_ntz"))
    counts = rows.groupBy("timewindow_start", "hashtag").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("user_id").alias("n_users"))
    total = F.sum("count").over(Window.partitionBy("timewindow_start"))
    return counts.withColumn("percent", F.round(F.col("count") / total * 100, 2)).orderBy("timewindow_start", F.desc("count"), "hashtag")


def share_with_users(uses: DataFrame, window: str) -> DataFrame:
    """One window's tags with all and distinct users as lists, and shares."""
    rows = uses.where(F.col("timewindow_start") == F.lit(window).cast("timestamp_ntz"))
    lists = rows.groupBy("timewindow_start", "hashtag").agg(F.array_sort(F.collect_list("user_id")).alias("users_all"), F.array_sort(F.collect_set("user_id")).alias("users_unique"))
    return window_share(rows).join(lists, ["timewindow_start", "hashtag"])


def tag_users(uses: DataFrame, hashtag: str, window: str | None = None) -> DataFrame:
    """``user_id, count`` of one tag, most frequent first."""
    rows = uses.where(F.col("hashtag") == hashtag)
    if window is not None:
        rows = rows.where(F.col("timewindow_start") == F.lit(window).cast("timestamp_ntz"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "user_id")


def raw_posts(df: DataFrame, user_id, hashtag: str, start: str, end: str, *, user: str = "user_id", text: str = "text", ts: str = "timestamp") -> DataFrame:
    """A user's posts with a tag between two times, both included.

    The tag is taken literally, not as a pattern. Times with a zone count,
    and are shown, as wall clock in UTC.
    """
    df = df.withColumn(ts, utc_wall_clock(F.col(f"`{ts}`"), dict(df.dtypes)[ts]))
    inside = F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    rows = df.where(inside & (F.col(user) == user_id) & F.contains(F.col(text), F.lit(hashtag)))
    return rows.select(F.col(user).alias("user_id"), F.col(text).alias("text"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("time")).orderBy("time")
