"""Time windows, concentration, coordination and streams."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoalwatch.functions.stats import gini
from shoalwatch.functions.timebins import with_sliding, with_tumbling
from shoalwatch.operators import coordination, hashtags, posts
from shoalwatch.streaming import windows

T0 = dt.datetime(2024, 1, 31, 10, 7, 30)


@pytest.mark.parametrize(("counts", "value"), [([1000], 0), ([1] * 25, 0), ([5] * 25, 0), ([9999] + [1] * 25, 0.95), ([], None)])
def test_gini(spark, counts, value):
    got = spark.createDataFrame([(counts,)], "c array<long>").select(gini(F.col("c"))).first()[0]
    assert got == pytest.approx(value, abs=1e-2) if value is not None else got is None


@pytest.mark.parametrize(("unit", "amount"), [("second", 30), ("minute", 5), ("hour", 12), ("day", 1), ("week", 2)])
def test_fixed_bins(spark, unit, amount):
    size = dt.timedelta(seconds=amount * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit])
    times = [T0 + dt.timedelta(seconds=s, microseconds=7) for s in (5, 100, 99999, 1234567, 3000000)] + [T0]
    out = with_tumbling(spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz"), "ts", unit, amount).collect()
    for r in out:
        assert r["timewindow_start"] == T0 + ((r["ts"] - T0) // size) * size


def test_calendar_bins(spark):
    times = [dt.datetime(2024, 1, 31, 10), dt.datetime(2024, 2, 29, 9), dt.datetime(2024, 2, 29, 10), dt.datetime(2024, 3, 30), dt.datetime(2025, 1, 31, 10)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    months = [r["timewindow_start"] for r in with_tumbling(df, "ts", "month", 1).orderBy("ts").collect()]
    assert months == [times[0], times[0], dt.datetime(2024, 2, 29, 10), dt.datetime(2024, 2, 29, 10), dt.datetime(2025, 1, 31, 10)]
    years = {r["timewindow_start"] for r in with_tumbling(df, "ts", "year", 1).collect()}
    assert years == {times[0], dt.datetime(2025, 1, 31, 10)}


def test_sliding_windows_start_with_the_data(spark):
    times = [dt.datetime(2024, 1, 1, 0, 12), dt.datetime(2024, 1, 1, 0, 21), None]
    out = with_sliding(spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz"), "ts", "15 minutes", "5 minutes").collect()
    got = sorted((r["ts"].minute, r["window_start"].minute) for r in out)
    assert got == [(12, 10), (21, 10), (21, 15), (21, 20)]


def brute_pairs(rows):
    slots = {(u, t.replace(minute=t.minute - t.minute % 5, second=0)) for u, t in rows if u and t}
    first = min(s for _, s in slots)
    windows = {(u, s - dt.timedelta(minutes=5 * k)) for u, s in slots for k in range(3)}
    by = {}
    for u, s in windows:
        if s >= first:
            by.setdefault(s, set()).add(u)
    return Counter((a, b) for users in by.values() for a in users for b in users)


def test_coordination(spark):
    rows = [("abcde"[i * 7 % 5], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * i % 61)) for i in range(40)] + [(None, T0), ("a", None)]
    df = spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz")
    want = brute_pairs(rows)
    got = {(r[0], r[1]): r[2] for r in coordination.cooccurrence(df).collect()}
    assert got == dict(want)
    one_way = coordination.cooccurrence(df, include_self=False, both_orders=False).collect()
    assert {(r[0], r[1]) for r in one_way} == {p for p in want if p[0] < p[1]}
    assert coordination.cooccurrence(df.where("false")).count() == 0


def test_temporal(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 5),), (dt.datetime(2024, 1, 2, 23, 5),), (dt.datetime(2024, 1, 2, 3),), (None,)]
    out = posts.temporal_profile(spark.createDataFrame(rows, "timestamp timestamp_ntz")).collect()
    assert [tuple(r) for r in out] == [(0, None, None), (1, "03:00:00", "04:00:00"), (2, "23:00:00", "00:00:00")]
    labels = posts.temporal_labels(posts.temporal_profile(spark.createDataFrame(rows[:1], "timestamp timestamp_ntz"))).first()
    assert tuple(labels) == ("23:00-00:00", 1)


def test_hashtags(spark):
    rows = [("u1", "#A #b. x", T0), ("u2", "#A y #A", T0 + dt.timedelta(hours=3)), ("u3", "no tag", T0 - dt.timedelta(hours=9)), ("u1", "#c", T0 + dt.timedelta(hours=40)), ("u2", "#c #d #c", T0 + dt.timedelta(hours=13)), ("u9", None, T0)]
    df = spark.createDataFrame(rows, "user_id string, text string, timestamp timestamp_ntz")
    out = hashtags.hashtag_analysis(df, unit="hour", amount=12).collect()
    assert [r["timewindow_start"] for r in out] == ["2024-01-31 10:07:30", "2024-01-31 22:07:30", "2024-02-01 22:07:30"]
    assert (out[0]["users"], out[0]["hashtags"]) == (["u1", "u1", "u2", "u2"], ["#A", "#b.", "#A", "#A"])
    assert [r["count"] for r in out] == [4, 3, 1]
    assert out[0]["gini"] == pytest.approx(0.25) and out[0]["gini_smooth"] is None and out[2]["gini_smooth"] is None
    assert out[1]["gini_smooth"] == pytest.approx((out[0]["gini"] + out[1]["gini"] + out[2]["gini"]) / 3)
    strings = df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    assert hashtags.hashtag_analysis(strings, unit="hour", amount=12).count() == 3
    uses = hashtags.window_tags(hashtags.tagged_posts(df), "hour", 12)
    share = hashtags.share_with_users(uses, "2024-01-31 10:07:30").where("hashtag = '#A'").first()
    assert (share["percent"], share["users_all"], share["users_unique"]) == (75.0, ["u1", "u2", "u2"], ["u1", "u2"])
    assert [tuple(r) for r in hashtags.tag_users(uses, "#A").collect()] == [("u2", 2), ("u1", 1)]
    assert hashtags.raw_posts(df, "u1", "#b.", "2024-01-31 10:07:30", "2024-02-05 00:00:00").count() == 1
    with pytest.raises(ValueError, match="hashtag"):
        hashtags.hashtag_analysis(df.where("text = 'no tag'"))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"user_id": "u", "text": "#a #b", "timestamp": f"2024-01-01 0{h}:10:00"} for h in range(5)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("user_id string, text string, timestamp timestamp").json(str(tmp_path / "in"))
    for k, (df, n) in enumerate([(windows.hourly_counts(stream), 5), (windows.hashtag_counts(stream), 10), (windows.active_users(stream), 15)]):
        query = df.writeStream.format("memory").queryName(f"out{k}").outputMode("complete").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(f"out{k}").count() == n
