"""Skew, samples, prefix sums and exports: what has to hold when one key or file is large."""

from __future__ import annotations

import json
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwatch import registry as query_registry
from shoalwatch.functions import numbering, timebins
from shoalwatch.functions.sampling import seeded_sample
from shoalwatch.functions.stats import grouped_gini
from shoalwatch.operators import coordination, hashtags, ngrams
from shoalwatch.plans import semantics
from shoalwatch.sources import excel, registry, sinks
from shoalwatch.sources.csv import Dialect


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def task_rows(df):
    """Rows of each partition."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


# --- co-posting ---


@pytest.mark.parametrize("block", [1, 3, 512])
def test_blocks_lose_no_pair(spark, block):
    rng = random.Random(3)
    rows = [(rng.randrange(12), f"2024-01-01 00:{rng.randrange(40):02d}:00") for _ in range(120)]
    df = spark.createDataFrame(rows, "user_id long, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    windows: dict = {}
    for r in coordination.window_users(df).collect():
        windows.setdefault(r["window_start"], set()).add(r["user_id"])
    want = Counter((a, b) for users in windows.values() for a in users for b in users)
    got = coordination.cooccurrence(df, block=block).collect()
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)


def test_a_hot_window_is_many_tasks(spark):
    """All users post at once: no task makes more than a fiftieth of the pairs."""
    users = spark.range(6000).select(F.lit("2024-01-01").alias("window_start"), F.col("id").alias("user_id"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        sizes = task_rows(coordination._pairs(users, 128))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sum(sizes) == 6000 * 5999 // 2
    assert max(sizes) <= sum(sizes) / 50


def test_pairs_are_counted_where_they_are_made(spark):
    """Lists of users are shuffled, by cell and by the order; no pair is."""
    rows = [(u, f"2024-01-01 00:{5 * (u % 3):02d}:00") for u in range(40)]
    df = spark.createDataFrame(rows, "user_id long, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    out = coordination.cooccurrence(df, block=4)
    assert out.count() == len({(a, b) for a in range(40) for b in range(40)})
    dealt = [line for line in plan(out).splitlines() if "Exchange" in line]
    assert dealt and not any("user_id_2" in line or "other" in line for line in dealt)
    counts = [r["cooccurrence_count"] for r in out.collect()]
    assert counts == sorted(counts, reverse=True)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_partners_are_counted_by_window(spark, kind):
    """No pair is a row before it is counted, and numbers are sent packed, whatever the blocks."""
    rng = random.Random(6)
    users = [rng.randrange(1 << 40) if kind == "long" else f"u{rng.randrange(1 << 40)}" for _ in range(30)]
    rows = [(rng.choice(users), f"2024-01-{1 + rng.randrange(3):02d} 00:{rng.randrange(60):02d}:00") for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, "2024-01-01 00:00:00")], f"user_id {kind}, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    windows: dict = {}
    for r in coordination.window_users(df).collect():
        windows.setdefault(r["window_start"], set()).add(r["user_id"])
    every = Counter((a, b) for us in windows.values() for a in us for b in us)
    for options in ({}, {"block": 7}, {"include_self": False, "min_count": 2}, {"both_orders": False, "block": 4}):
        want = {p: n for p, n in every.items() if n >= options.get("min_count", 1) and (p[0] != p[1] or options.get("include_self", True)) and (p[0] <= p[1] or options.get("both_orders", True))}
        out = coordination.cooccurrence(df, **options)
        assert [tuple(r) for r in out.collect()] == sorted(((a, b, n) for (a, b), n in want.items()), key=lambda r: (-r[2], r[0], r[1]))
        assert not any("Aggregate" in line and "user_id_2" in line for line in plan(out).splitlines())
    sent = {f.name: f.dataType.simpleString() for f in coordination._lists(df, "user_id", "timestamp")[0].schema}
    assert sent["partners"] == ("binary" if kind == "long" else "array<string>")
    assert coordination.cooccurrence(df.where("false")).count() == 0


def test_places_of_pairs_without_sorting_pairs(spark, monkeypatch):
    """The order is that of lists of partners, which are in order themselves."""
    given = []
    monkeypatch.setattr(query_registry, "in_order", lambda df, name: given.append(plan(df)) or df.withColumn(name, F.lit(0)))
    query_registry.QUERIES["coordination_order"](spark, "/root/testdata/sf0.001")
    sorts = [line for line in given[0].splitlines() if "Sort [" in line]
    assert sorts and not any("user_id_2" in line for line in sorts)


def test_steps_of_numbers():
    rng = random.Random(2)
    for n, top in ((1, 10), (2, 1 << 60), (300, 400), (300, 1 << 17), (50, 1 << 62)):
        values = np.array(sorted(rng.sample(range(-min(top, 1 << 61), top), n)))
        assert (coordination._unpacked(coordination._packed(values)) == values).all()
    ends = np.array([-(1 << 63), -5, (1 << 63) - 1])
    assert (coordination._unpacked(coordination._packed(ends)) == ends).all()
    for n, top in ((1, 10), (300, 400), (300, 1 << 17), (50, 1 << 62)):
        values = [rng.randrange(top) for _ in range(n)]
        mixed = np.array([rng.choice(values) for _ in range(n)])
        assert (coordination._order(mixed) == np.argsort(mixed, kind="stable")).all()


# --- n-grams ---


def bot_tables(spark, copies):
    """One message over and over by one user, and a few others."""
    bot = spark.range(copies).select(F.col("id").alias("t"), F.lit("bot").alias("user_id"), F.concat(F.lit("m"), "id").alias("message_id"), F.lit("buy now and save much").alias("message_text"))
    rest = spark.createDataFrame([(copies + i, f"u{i % 3}", f"x{i}", "buy now and go home") for i in range(9)], bot.schema)
    return ngrams.ngram_tables(bot.union(rest), ts="t", order=["t"], tokens=F.split("message_text", " "))


def test_full_report_of_a_bot(spark):
    tables = bot_tables(spark, 300)
    want = {(r["ngram_id"], r["message_surrogate_id"]): tuple(r) for r in ngrams.ngram_full_report(tables).collect()}
    small = ngrams.ngram_full_report(tables, slice_uses=7)
    assert {(r["ngram_id"], r["message_surrogate_id"]): tuple(r) for r in small.collect()} == want
    reps = {(r["words"], r["user_id"]): r["reps_per_user"] for r in small.collect()}
    assert reps["buy now and", "bot"] == 300 and reps["buy now and", "u0"] == 3 and reps["now and save", "bot"] == 300
    assert len(want) == 6 * 300 + 6 * 9
    assert "windowspecdefinition(ngram_id" not in plan(small)
    before = ngrams.ngram_summary(tables)
    assert {tuple(r) for r in ngrams.ngram_full_report(tables, before).collect()} == set(want.values())


def test_a_bot_is_many_slices(spark):
    tables = bot_tables(spark, 20_000)
    uses = ngrams.report_uses(tables, slice_uses=500)
    hot = uses.where("words = 'buy now and' and user_id = 'bot'")
    assert hot.count() == 20_000 and hot.first()["reps_per_user"] == 20_000


def test_tables_of_ngrams_are_made_when_asked_for(spark, monkeypatch):
    """Authors alone make no n-grams, and no table between holds their words."""
    made = {}

    def recorded(df, tag, *by, write=ngrams.written):
        made[tag] = df.columns
        return write(df, tag, *by)

    monkeypatch.setattr(ngrams, "written", recorded)
    posts = [("u1", "m1", "a b c d", 1), ("u2", "m2", "x a b c", 2), ("u1", "m3", "", 3)]
    tables = ngrams.ngram_tables(spark.createDataFrame(posts, "user_id string, message_id string, message_text string, timestamp long"), tokens=F.split("message_text", " "), max_n=4)
    assert tables.message_authors.count() == 2 and not made
    assert sorted(map(tuple, tables.ngrams.collect())) == [(0, "a b c", 3), (1, "a b c d", 4), (2, "b c d", 3), (3, "x a b", 3), (4, "x a b c", 4)]
    assert sorted(map(tuple, tables.message_ngrams.collect())) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 3), (2, 4)]
    assert [tuple(r) for r in ngrams.ngram_summary(tables).collect()] == [(0, "a b c", 3, 2, 2)]
    assert made and not any("words" in columns for columns in made.values())


@pytest.mark.parametrize("name, kept", [("ngram_full_report_order", {"ngram_id", "message_surrogate_id"}), ("ngram_summary_order", {"ngram_id", "words"}), ("coordination_order", {"user_id_1", "user_id_2"})])
def test_orders_write_no_other_columns(spark, monkeypatch, name, kept):
    """Places are given to the columns that are returned, not to whole reports with their texts."""
    given = []
    monkeypatch.setattr(query_registry, "in_order", lambda df, name: given.append(set(df.columns)) or df.withColumn(name, F.lit(0)))
    query_registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert given == [kept]


def test_posts_report_the_chosen_alone(spark, monkeypatch):
    given = []
    monkeypatch.setattr(ngrams, "ngram_full_report", lambda tables, summary, report=ngrams.ngram_full_report: given.append(summary.count()) or report(tables, summary))
    query_registry.QUERIES["ngram_posts"](spark, "/root/testdata/sf0.001")
    assert given == [5]


# --- concentration, rolling means, sums ---


def test_gini_from_counts_of_counts(spark):
    rng = random.Random(8)
    groups = {g: [rng.choice([1, 1, 1, 2, 5, rng.randint(1, 900)]) for _ in range(n)] for g, n in enumerate([1, 2, 7, 300, 3000])}
    groups[9] = [4] * 50
    rows = [(g, v) for g, values in groups.items() for v in values] + [(1, None)]

    def plain(x):
        x, n = sorted(x), len(x)
        sums, total = 0, 0
        for v in x:
            total += v
            sums += total
        return (n + 1 - 2 * sums / total) / n

    counts = spark.createDataFrame(rows, "g int, v long")
    out = grouped_gini(counts, "g", "v")
    assert {r["g"]: (r["total"], r["n"]) for r in out.collect()} == {g: (sum(x), len(x)) for g, x in groups.items()}
    assert all(r["gini"] == pytest.approx(plain(groups[r["g"]]), abs=1e-9) for r in out.collect())
    assert "collect_list" not in plan(out)
    zero = grouped_gini(spark.createDataFrame([(1, 0)], "g int, v long"), "g", "v").first()
    assert (zero["total"], zero["gini"]) == (0, None)


def test_tables_without_lists(spark):
    posts = spark.createDataFrame([(f"u{i}", f"#t{i % 3} #all", f"2024-01-01 0{i % 9}:10:00") for i in range(40)], "user_id string, text string, timestamp string")
    lean, full = (hashtags.hashtag_analysis(posts, lists=x) for x in (False, True))
    assert lean.columns == [c for c in full.columns if c not in ("users", "hashtags")]
    assert lean.collect() == full.select(lean.columns).collect()
    assert "collect_list" not in plan(lean)


@pytest.mark.parametrize("halo", [2, 3, 4096])
@pytest.mark.parametrize("reach", [1, 2])
def test_rolling_mean_by_ranges(spark, monkeypatch, halo, reach):
    monkeypatch.setattr(timebins, "HALO", halo)
    values = [random.Random(i).random() for i in range(25)]
    df = spark.createDataFrame([(i * 10, v) for i, v in enumerate(values)], "at long, v double").repartition(5)
    out = timebins.with_rolling_mean(df, "v", "at", "mean", reach)
    assert out.columns == ["at", "v", "mean"] and "SinglePartition" not in plan(out)
    got = {r["at"] // 10: r["mean"] for r in out.collect()}
    for i in range(25):
        inside = reach <= i < 25 - reach
        assert got[i] == (pytest.approx(sum(values[i - reach : i + reach + 1]) / (2 * reach + 1)) if inside else None)


@pytest.mark.parametrize("group", [2, 3, 4096])
def test_sums_by_levels(spark, group):
    keys = sorted(random.Random(4).sample(range(500), 60))
    df = spark.createDataFrame([(k, k * 7 % 13) for k in keys], "k int, v long").repartition(4)
    got = {r["k"]: r["before"] for r in numbering.sums_before(df, "k", "v", "before", group=group).collect()}
    total, want = 0, {}
    for k in keys:
        want[k], total = total, total + k * 7 % 13
    assert got == want
    assert numbering.sums_before(df.where("false"), "k", "v", "before").count() == 0


# --- samples ---


def test_samples_follow_the_rows(spark):
    df = spark.range(5000).withColumn("t", F.concat(F.lit("x"), "id"))
    one = seeded_sample(df, 100).collect()
    assert len(one) == 100 and one == seeded_sample(df.repartition(7, "t").orderBy(F.desc("id")), 100).collect()
    assert one != seeded_sample(df, 100, seed=1).collect()
    copies = spark.range(20_000).select((F.col("id") % 150).alias("id"))
    assert len({r["id"] for r in seeded_sample(copies, 100).collect()}) == 100
    few = copies.where("id < 5")
    assert seeded_sample(few, 100).count() == few.count()
    assert seeded_sample(df.where("false"), 100).count() == 0
    assert seeded_sample(df.withColumn("m", F.create_map("t", "id")).withColumn("h_", F.lit(1)), 10).count() == 10


def test_meaning_of_columns_that_begin_otherwise(spark):
    """The first rows alone would make these columns something else."""
    df = spark.range(3000).select(F.when(F.col("id") < 150, F.lit("word")).otherwise(F.concat(F.lit("a longer phrase "), "id")).alias("words"), F.when(F.col("id") < 150, F.lit("none")).otherwise(F.concat(F.lit("2024-01-01 10:00:"), F.format_string("%02d", F.col("id") % 60))).alias("at"))
    for rows in (df, df.repartition(6)):
        assert {c: s.type for c, s in semantics.infer(rows).items()} == {"words": "text", "at": "datetime"}


def test_zones_become_utc(spark):
    times = {"2024-05-01 10:00:00+02:00": "08:00", "2024-05-01T10:00:00Z": "10:00", "2024-05-01 10:00:00": "10:00", "2024-05-01 10:00:00 America/New_York": "14:00", "2024-05-01 10:00:00 UTC": "10:00", "soon": None}
    df = spark.createDataFrame([(str(i), "#a", t) for i, t in enumerate(times)], "user_id string, text string, timestamp string")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = {r["user_id"]: r["ts"] and f"{r['ts']:%H:%M}" for r in hashtags.tagged_posts(df).collect()}
            assert list(got.values()) == list(times.values())
            shown = hashtags.raw_posts(df, "0", "#a", "2024-05-01 07:00:00", "2024-05-01 09:00:00", ts="timestamp").collect()
            assert [r["time"] for r in shown] == ["2024-05-01 08:00:00"]
            instants = df.where("user_id = '0'").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
            assert f"{hashtags.tagged_posts(instants).first()['ts']:%H:%M}" == "08:00"
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


# --- exports ---


def files(folder):
    return sorted(p.name for p in Path(folder).iterdir() if not p.name.endswith(".crc"))


def test_chunks_are_files(spark, tmp_path):
    df = spark.range(1050).select("id", F.concat(F.lit('a "b",\n'), "id").alias("t"), F.when(F.col("id") % 2 == 0, F.col("id") / 2).alias("x")).repartition(5)
    for kind in ("csv", "json", "xlsx", "parquet"):
        folder = tmp_path / kind
        folder.mkdir()
        paths = sinks.export(df, str(folder / "out"), kind, sinks.ExportPolicy(100), order=["id"])
        assert files(folder) == sorted(f"out_{k}.{kind}" for k in range(11)) == sorted(Path(p).name for p in paths)
        assert all(p.is_file() for p in folder.iterdir())
        options = {"dialect": Dialect()} if kind == "csv" else {}
        back = [registry.load(spark, p, **options).orderBy("id").collect() for p in (paths[0], paths[10])]
        assert [len(b) for b in back] == [100, 50] and [back[0][0]["id"], back[1][0]["id"]] == [0, 1000]
        assert back[0][7]["t"] == 'a "b",\n7' and back[0][7]["x"] is None and back[0][8]["x"] == 4
    assert [r["id"] for r in json.loads((tmp_path / "json" / "out_1.json").read_text())] == list(range(100, 200))
    assert (tmp_path / "csv" / "out_0.csv").read_text().startswith("id,t,x\n0,")


@pytest.mark.parametrize("calm", [True, False])
def test_csv_brings_texts_back_whole(spark, tmp_path, calm):
    """White space at the ends of texts stays, and empty texts aren't null, in files with and without line breaks in fields."""
    texts = ["", None, " ", " a", "a ", "\ta\t", "\x00", "a\x00", "\x1c", "\x01b", '"', '""', '" "', "\\", "a,b "] + ([] if calm else ["\n", "a\n", "\na", "a\r", "\ra\r\n", '\r"', '"\n"', " \n "])
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate([(x, "web") for x in texts] + [("web", x) for x in texts])], "doc_id long, source string, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = query_registry.QUERIES["csv_round_trip"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_one_file(spark, tmp_path):
    df = spark.range(5).withColumn("l", F.array("id"))
    for kind in ("csv", "json", "xlsx"):
        for rows in (df, df.where("false"), spark.createDataFrame([], df.schema)):
            flat = rows if kind == "json" else rows.drop("l")
            target = Path(sinks.write(flat, str(tmp_path / "one"), kind))
            assert target.is_file() and registry.load(spark, str(target)).count() == rows.count()
    assert json.loads((tmp_path / "one.json").read_text()) == []


def test_nothing_is_left_of_failed_exports(spark, tmp_path):
    df = spark.range(300).withColumn("x", F.when(F.col("id") == 250, F.raise_error(F.lit("broken"))).otherwise(F.lit("1")))
    for kind in ("csv", "json", "xlsx", "parquet"):
        (tmp_path / f"out.{kind}").write_text("old")
        with pytest.raises(Exception, match="broken"):
            sinks.write(df, str(tmp_path / "one"), kind) if kind != "parquet" else sinks.export(df, str(tmp_path / "one"), kind, sinks.ExportPolicy(100))
    assert [f for f in files(tmp_path) if not f.startswith("out.") and f != "one.parquet"] == []
    with pytest.raises(Exception, match="sheet holds"):
        old, excel.SHEET_ROWS = excel.SHEET_ROWS, 0
        try:
            excel._book(str(tmp_path / "x"), ["a"], iter([[1]]))
        finally:
            excel.SHEET_ROWS = old


def test_several_workbooks(spark, tmp_path):
    df = spark.range(250).withColumn("t", F.lit("x\x00y"))
    sinks.export(df, str(tmp_path / "b"), "xlsx", sinks.ExportPolicy(100), order=["id"])
    back = registry.load(spark, str(tmp_path / "b_*.xlsx"))
    assert back.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in back.collect()) == list(range(250)) and back.first()["t"] == "xy"
    with pytest.raises(ValueError, match="mounted"):
        excel.read_excel(spark, "hdfs://x/y.xlsx")
