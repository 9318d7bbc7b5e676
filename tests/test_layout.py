"""Drill-downs that read little: word buckets and clustered files."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from shoalwatch.operators import hashtags, layout, ngrams


def scanned_files(df):
    """Files that the scans of a plan without shuffles have opened."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()))


def test_search_by_word(spark):
    rng = random.Random(6)
    vocabulary = ["the", "café", "caf", "don't", "#sale", "#sales", "@ana", "u.k.", "re-open", "sale", "x_1", "straße", "ſea", "sea", "1,200", "the-end", "и", "ét"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(n)), n, i % 7, 1) for i, n in enumerate(rng.choice([3, 4, 5]) for _ in range(400))]
    summary = spark.createDataFrame(rows, "ngram_id long, words string, n int, total_reps long, distinct_posters long").cache()
    index = layout.index_words(summary, buckets=16)
    for term in [*vocabulary, "The", "CAFÉ", "sale the", "the don't", "t", "k", "-", "#", "open the", "nothing", "", None, "ana #sale", "SſEA", "\\Q", "u.k"]:
        for lengths in (None, [3, 4], []):
            want = ngrams.search(summary, term, lengths)
            got = index.search(term, lengths)
            assert got.columns == want.columns
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), term
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(key, "false")  # else the plan doesn't say which buckets it reads
    try:
        plan = index.search("sale the")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    assert "SelectedBucketsCount: 1 out of 16" in plan


def test_drill_downs_skip_files(spark):
    start = dt.datetime(2024, 1, 1)
    events = spark.range(20_000).select((F.col("id") * 7919 % 200).alias("user_id"), (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("timestamp"), F.concat(F.lit("#t"), F.col("id") % 9).alias("text"))
    kept = layout.clustered(events, "user_id", "timestamp", files=50)
    span = start + dt.timedelta(days=2), start + dt.timedelta(days=9)
    found = hashtags.raw_posts(kept.where(user_id=17, timestamp=span), 17, "#t3", *map(str, span), ts="timestamp")
    want = hashtags.raw_posts(events, 17, "#t3", *map(str, span), ts="timestamp")
    assert found.collect() == want.collect() and want.count() > 0
    assert 1 <= scanned_files(kept.where(user_id=17, timestamp=span)) < 5 <= len(kept.bounds) / 10
    assert kept.where(user_id=999).count() == 0 and kept.where(user_id=None).count() == 20_000
    # a value that most rows have is cut by the key behind it
    hot = layout.clustered(events.withColumn("user_id", F.lit(1)), "user_id", "timestamp", files=50)
    assert scanned_files(hot.where(user_id=1, timestamp=(span[0], span[0]))) < 5
    empty = layout.clustered(events.where("false"), "user_id", files=5)
    assert empty.where(user_id=1).count() == 0


def test_posts_of_an_ngram_skip_files(spark):
    full = spark.range(5000).select((F.col("id") % 500).alias("ngram_id"), F.concat(F.lit("w"), F.col("id") % 500).alias("words"), F.lit("u").alias("user_id"), F.lit(10).alias("reps_per_user"), F.lit("text").alias("message_text"), F.timestamp_seconds("id").alias("timestamp"))
    kept = layout.clustered(full, "ngram_id", files=40)
    rows = kept.where(ngram_id=77)
    assert scanned_files(rows) <= 2
    chosen = spark.createDataFrame([(77,)], "ngram_id long")
    order = ["ngram_id", "posted"]
    assert ngrams.posts_of(rows, chosen).orderBy(order).collect() == ngrams.posts_of(full, chosen).orderBy(order).collect()
