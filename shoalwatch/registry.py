"""Registered queries over the test tables and the SQL that checks them.

Events stand in for posts (user_id, ts, and a tag made of the event type),
conversations for messages (author: role; id: conversation and turn), and
documents for texts. Queries run over whole tables.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwatch.functions import tokenizer
from shoalwatch.functions.tokenizer import tokenize, tokenize_ascii
from shoalwatch.operators import coordination, hashtags, layout, ngrams, posts
from shoalwatch.functions.numbering import in_order, numbered
from shoalwatch.plans import automap, compare, semantics
from shoalwatch.plans.schema import Column
from shoalwatch.session import scratch, spread, written
from shoalwatch.sources import registry as importers
from shoalwatch.sources.csv import Dialect, read_csv
from shoalwatch.sources.sinks import ExportPolicy, export, export_name, human_columns, with_chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- single posts ---


def _counts(spark, sf_dir) -> DataFrame:
    return posts.character_count(_table(spark, sf_dir, "documents"), "doc_id", "text", fudge_factor=10)


@_query("SELECT doc_id AS message_id, length(text) + 10 AS character_count FROM documents")
def char_count(spark, sf_dir):
    return _counts(spark, sf_dir)


@_query("SELECT doc_id AS message_id, length(text) + 10 AS character_count, length(text) + 10 > 1000 AS is_long FROM documents")
def long_message_report(spark, sf_dir):
    return posts.long_message_report(_counts(spark, sf_dir), longer_than=1000)


@_query("""
WITH c AS (SELECT length(text) + 10 AS n FROM documents), e AS (SELECT min(n) AS lo, max(n) AS hi FROM c)
SELECT least(CAST(floor((n - lo) / greatest(1e-9, (hi - lo) / 50.0::DOUBLE)) AS BIGINT), 49) AS bin, count(*) AS count FROM c, e WHERE n IS NOT NULL GROUP BY 1""")
def message_length_histogram(spark, sf_dir):
    return posts.length_histogram(_counts(spark, sf_dir)).select("bin", "count")


_PROFILE = """SELECT count(ts) AS count, printf('%02d:00:00', hour(ts)) AS time_interval_start, printf('%02d:00:00', (hour(ts) + 1) % 24) AS time_interval_end FROM events GROUP BY hour(ts)"""


@_query(_PROFILE)
def temporal_interval_count(spark, sf_dir):
    return posts.temporal_profile(_table(spark, sf_dir, "events"), "ts")


@_query(f"SELECT time_interval_start[1:5] || '-' || time_interval_end[1:5] AS label, count FROM ({_PROFILE})")
def temporal_interval_label(spark, sf_dir):
    return posts.temporal_labels(posts.temporal_profile(_table(spark, sf_dir, "events"), "ts"))


# --- coordination ---

_WINDOW_USERS = """
WITH e AS (SELECT DISTINCT user_id, time_bucket(INTERVAL '5 minutes', ts) AS b FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT DISTINCT user_id, b - k * INTERVAL '5 minutes' AS window_start FROM e, range(0, 3) t(k)),
u AS (SELECT * FROM w WHERE window_start >= (SELECT min(b) FROM e))"""


@_query(f"{_WINDOW_USERS} SELECT window_start, user_id FROM u")
def coordination_windows(spark, sf_dir):
    return coordination.window_users(_table(spark, sf_dir, "events"), "user_id", "ts")


@_query(f"{_WINDOW_USERS} SELECT a.user_id AS user_id_1, b.user_id AS user_id_2, count(*) AS cooccurrence_count FROM u a JOIN u b USING (window_start) GROUP BY 1, 2")
def coordination_pairs(spark, sf_dir):
    return coordination.cooccurrence(_table(spark, sf_dir, "events"), "user_id", "ts")


# --- hashtags ---

_TAG = r"regexp_extract_all(text, '#[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')"


@_query(f"SELECT doc_id, unnest({_TAG}) AS hashtag FROM documents")
def hashtag_extract(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(hashtags.extract_hashtags(F.col("text"))).alias("hashtag"))


@_query(f"SELECT hashtag, count(*) AS count FROM (SELECT unnest({_TAG}) AS hashtag FROM documents) GROUP BY 1")
def hashtag_counts(spark, sf_dir):
    return hashtag_extract(spark, sf_dir).groupBy("hashtag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "hashtag")


def _uses(spark, sf_dir) -> DataFrame:
    tagged = _table(spark, sf_dir, "events").withColumn("text", F.concat(F.lit("#"), "event_type"))
    return hashtags.window_tags(hashtags.tagged_posts(tagged, "user_id", "text", "ts"), "hour", 12)


_USES = """
WITH p AS (SELECT user_id, ts, '#' || event_type AS hashtag FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
uses AS (SELECT time_bucket(INTERVAL '12 hours', ts, (SELECT min(ts) FROM p)) AS timewindow_start, user_id, ts, hashtag FROM p)"""
_GINI = f"""{_USES},
c AS (SELECT timewindow_start, hashtag, count(*) AS c FROM uses GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY timewindow_start ORDER BY c, hashtag) AS i, count(*) OVER (PARTITION BY timewindow_start) AS n FROM c),
g AS (SELECT timewindow_start, CAST(sum(c) AS BIGINT) AS count, max(n) AS n_hashtags, (max(n) + 1 - 2 * sum(c * (n - i + 1)) / sum(c)::DOUBLE) / max(n) AS gini FROM r GROUP BY 1)"""


@_query(f"{_GINI} SELECT timewindow_start, count, n_hashtags, round(gini, 9) AS gini FROM g")
def hashtag_gini_windows(spark, sf_dir):
    return hashtags.concentration(_uses(spark, sf_dir)).select("timewindow_start", "count", "n_hashtags", F.round("gini", 9).alias("gini"))


@_query(f"""{_GINI} SELECT timewindow_start, round(CASE WHEN count(*) OVER w = 3 THEN avg(gini) OVER w END, 9) AS gini_smooth FROM g
WINDOW w AS (ORDER BY timewindow_start ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def hashtag_gini_smooth(spark, sf_dir):
    return hashtags.concentration(_uses(spark, sf_dir)).select("timewindow_start", F.round("gini_smooth", 9).alias("gini_smooth"))


@_query(f"""{_USES} SELECT strftime(timewindow_start, '%Y-%m-%d %H:%M:%S') AS timewindow_start, array_to_string(list(user_id ORDER BY ts, user_id, hashtag), ',') AS users,
array_to_string(list(hashtag ORDER BY ts, user_id, hashtag), ',') AS hashtags, count(*) AS count FROM uses GROUP BY uses.timewindow_start""")
def hashtag_analysis(spark, sf_dir):
    tagged = _table(spark, sf_dir, "events").withColumn("text", F.concat(F.lit("#"), "event_type"))
    out = hashtags.hashtag_analysis(tagged, "user_id", "text", "ts", unit="hour", amount=12)
    return out.select("timewindow_start", F.array_join(F.col("users").cast("array<string>"), ",").alias("users"), F.array_join("hashtags", ",").alias("hashtags"), "count")


@_query(f"""{_USES}, c AS (SELECT timewindow_start, hashtag, count(*) AS count, count(DISTINCT user_id) AS n_users FROM uses GROUP BY 1, 2)
SELECT *, round(count / sum(count) OVER (PARTITION BY timewindow_start)::DOUBLE * 100, 2) AS percent FROM c""")
def hashtag_window_share(spark, sf_dir):
    return hashtags.window_share(_uses(spark, sf_dir))


@_query(f"{_USES} SELECT user_id, count(*) AS count FROM uses WHERE hashtag = '#purchase' GROUP BY 1")
def hashtag_users(spark, sf_dir):
    return hashtags.tag_users(_uses(spark, sf_dir), "#purchase")


@_query("""SELECT user_id, '#' || event_type AS text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' AND user_id = 7 AND contains('#' || event_type, '#c')""")
def hashtag_posts(spark, sf_dir):
    tagged = _table(spark, sf_dir, "events").withColumn("text", F.concat(F.lit("#"), "event_type"))
    return hashtags.raw_posts(tagged, 7, "#c", "2024-01-05 00:00:00", "2024-01-15 00:00:00", ts="ts")


@_query(f"""{_USES}, w AS (SELECT DISTINCT timewindow_start FROM uses), r AS (SELECT *, row_number() OVER (ORDER BY timewindow_start) AS r, count(*) OVER () AS n FROM w)
SELECT timewindow_start, timewindow_start + INTERVAL '12 hours' AS timewindow_end FROM r WHERE r = n // 2 + 1""")
def hashtag_default_window(spark, sf_dir):
    found = hashtags.default_window(hashtags.concentration(_uses(spark, sf_dir)))
    return found.withColumn("timewindow_end", hashtags.window_end(F.col("timewindow_start"), "hour", 12))


@_query("""SELECT user_id, '#' || event_type AS text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' AND user_id = 11 AND contains('#' || event_type, '#c')""")
def hashtag_posts_clustered(spark, sf_dir):
    """A drill-down that opens the files of one user and time alone."""
    tagged = _table(spark, sf_dir, "events").withColumn("text", F.concat(F.lit("#"), "event_type"))
    span = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
    rows = layout.clustered(tagged, "user_id", "ts").where(user_id=11, ts=tuple(map(dt.datetime.fromisoformat, span)))
    return hashtags.raw_posts(rows, 11, "#c", *span, ts="ts")


_MONTHS = """WITH p AS (SELECT ts, (SELECT min(ts) FROM events) AS o FROM events WHERE ts IS NOT NULL),
g AS (SELECT ts, o, CAST(floor(((year(ts) - year(o)) * 12 + month(ts) - month(o)) / 1.0) AS BIGINT) AS k FROM p)"""


@_query(f"{_MONTHS} SELECT CASE WHEN o + to_months(k) <= ts THEN o + to_months(k) ELSE o + to_months(k - 1) END AS month_start, count(*) AS count FROM g GROUP BY 1")
def calendar_month_windows(spark, sf_dir):
    from shoalwatch.functions.timebins import with_tumbling

    events = _table(spark, sf_dir, "events").where("ts is not null")
    return with_tumbling(events, "ts", "month", 1, "month_start").groupBy("month_start").agg(F.count(F.lit(1)).alias("count"))


def _tokens_sql(text: str) -> str:
    """The tokenizer's default kinds as SQL: exact for texts of Latin letters, as the test tables have."""
    kinds = [tokenizer.URL, tokenizer.EMAIL, r"@[\p{L}\p{N}_]+", r"#[\p{L}\p{N}_]+", tokenizer.CASHTAG, tokenizer.NUMERIC.replace(r"(?!\w)", r"\b"), tokenizer.LATIN]
    union = re.sub(r"\\u([0-9A-F]{4})", lambda m: chr(int(m[1], 16)), "|".join(kinds)).replace("'", "''")
    # links lose the punctuation behind them, and so do dotted words that are no abbreviations
    link, dotted = rf"^(?:{tokenizer.URL})$", r"^[a-z]+(?:\.[a-z]+)+\.$"
    stripped = "rtrim(x, '.!?;:,)]}\"''')"
    tail = f"CASE WHEN regexp_matches(x, '{link}') AND NOT (contains(x, '@') AND contains(x, '.')) OR regexp_matches(x, '{dotted}') AND NOT regexp_full_match(x, '{tokenizer.ABBREVIATION}') THEN {stripped} ELSE x END"
    found = f"list_transform(regexp_extract_all(lower({text}), '{union}'), lambda x: {tail})"
    return f"(CASE WHEN {text} IS NULL THEN [] WHEN len({found}) = 0 AND trim({text}) <> '' THEN [trim(lower({text}))] ELSE {found} END)"


# --- n-grams ---


def _ngram_tables(spark, sf_dir, exact_ids: bool = True, ascii_only: bool = True) -> ngrams.NgramTables:
    turns = _table(spark, sf_dir, "conversations").withColumn("message_id", F.concat_ws("-", "conv_id", "turn"))
    tokens = tokenize_ascii(F.col("message_text")) if ascii_only else None
    return ngrams.ngram_tables(turns, "role", "message_id", "text", "turn", order=["conv_id", "turn", "role", "text"], tokens=tokens, exact_ids=exact_ids)


_ASCII_TOKENS = "regexp_extract_all(lower(message_text), '[a-z0-9]+')"
_NGRAMS = f"""
WITH m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS message_surrogate_id, concat_ws('-', conv_id, turn) AS message_id, text AS message_text, role AS user_id, turn AS timestamp FROM conversations),
k AS MATERIALIZED (SELECT *, {_ASCII_TOKENS} AS w FROM m WHERE message_text <> '' AND user_id <> ''),
e AS MATERIALIZED (SELECT message_surrogate_id, (i - 1) * 10 + n AS pos, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT message_surrogate_id, w, unnest(range(1, len(w) + 1)) AS i FROM k), range(3, 6) t(n) WHERE i + n - 1 <= len(w)),
f AS MATERIALIZED (SELECT message_surrogate_id, words, n, min(pos) AS pos FROM e GROUP BY 1, 2, 3),
d AS MATERIALIZED (SELECT words, n, row_number() OVER (ORDER BY first) - 1 AS ngram_id FROM (SELECT words, n, min((message_surrogate_id, pos)) AS first FROM f GROUP BY 1, 2)),
x AS MATERIALIZED (SELECT f.message_surrogate_id, d.ngram_id FROM f JOIN d USING (words)),
s AS MATERIALIZED (SELECT ngram_id, count(*) AS total_reps, count(DISTINCT user_id) AS distinct_posters FROM x JOIN k USING (message_surrogate_id) GROUP BY 1 HAVING count(*) > 1),
summary AS MATERIALIZED (SELECT ngram_id, words, CAST(n AS INTEGER) AS n, total_reps, distinct_posters FROM d JOIN s USING (ngram_id))"""


@_query(f"{_NGRAMS} SELECT * FROM x")
def ngram_occurrences(spark, sf_dir):
    return _ngram_tables(spark, sf_dir).message_ngrams


@_query(f"{_NGRAMS} SELECT ngram_id, words, CAST(n AS INTEGER) AS n FROM d")
def ngram_definitions(spark, sf_dir):
    return _ngram_tables(spark, sf_dir).ngrams


@_query(f"{_NGRAMS} SELECT message_surrogate_id, message_id, message_text, user_id, timestamp FROM k")
def message_authors(spark, sf_dir):
    return _ngram_tables(spark, sf_dir).message_authors


@_query(f"{_NGRAMS} SELECT * FROM summary")
def ngram_summary(spark, sf_dir):
    return ngrams.ngram_summary(_ngram_tables(spark, sf_dir))


@_query(f"{_NGRAMS} SELECT words, n, total_reps, distinct_posters FROM summary")
def ngram_summary_hashed(spark, sf_dir):
    return ngrams.ngram_summary(_ngram_tables(spark, sf_dir, exact_ids=False)).drop("ngram_id")


@_query(f"{_NGRAMS.replace(_ASCII_TOKENS, _tokens_sql('message_text'))} SELECT * FROM summary")
def ngram_summary_all_scripts(spark, sf_dir):
    """With the analysis' own tokenizer."""
    return ngrams.ngram_summary(_ngram_tables(spark, sf_dir, ascii_only=False))


@_query(f"""{_NGRAMS} SELECT ngram_id, n, words, total_reps, distinct_posters, user_id, CAST(count(*) OVER (PARTITION BY ngram_id, user_id) AS INTEGER) AS reps_per_user,
message_surrogate_id, message_id, message_text, timestamp FROM summary JOIN x USING (ngram_id) JOIN k USING (message_surrogate_id)""")
def ngram_full_report(spark, sf_dir):
    return ngrams.ngram_full_report(_ngram_tables(spark, sf_dir))


@_query(rf"{_NGRAMS} SELECT * FROM summary WHERE regexp_matches(words, '(?i)\bthe\b') AND n IN (3, 4)")
def ngram_search(spark, sf_dir):
    return ngrams.search(ngrams.ngram_summary(_ngram_tables(spark, sf_dir)), "the", [3, 4])


@_query(f"{_NGRAMS} SELECT ngram_id, true AS x_near, true AS y_near FROM summary")
def ngram_scatter(spark, sf_dir):
    """Jittered points stand within a twentieth of their n-gram's numbers."""
    near = lambda jittered, exact: F.abs(F.col(jittered) / F.col(exact) - 1) <= 0.05
    points = ngrams.scatter(ngrams.ngram_summary(_ngram_tables(spark, sf_dir)))
    return points.select("ngram_id", near("x", "distinct_posters").alias("x_near"), near("y", "total_reps").alias("y_near"))


@_query(rf"{_NGRAMS} SELECT * FROM summary WHERE regexp_matches(words, '(?i)\bof the\b')")
def ngram_search_indexed(spark, sf_dir):
    """A search that reads one bucket of a word index."""
    return layout.index_words(ngrams.ngram_summary(_ngram_tables(spark, sf_dir))).search("of the")


@_query(f"{_NGRAMS} SELECT * FROM summary ORDER BY total_reps DESC, distinct_posters DESC, n, words LIMIT 100")
def ngram_top100(spark, sf_dir):
    return ngrams.top(ngrams.ngram_summary(_ngram_tables(spark, sf_dir)))


@_query(f"""{_NGRAMS}, t AS (SELECT * FROM summary ORDER BY total_reps DESC, distinct_posters DESC, n, words LIMIT 5)
SELECT ngram_id, words, user_id, CAST(count(*) OVER (PARTITION BY ngram_id, user_id) AS INTEGER) AS reps_per_user, message_text FROM t JOIN x USING (ngram_id) JOIN k USING (message_surrogate_id)""")
def ngram_posts(spark, sf_dir):
    tables = _ngram_tables(spark, sf_dir)
    tables.message_authors = tables.message_authors.withColumn("timestamp", F.timestamp_seconds("timestamp"))
    chosen = written(ngrams.top(ngrams.ngram_summary(tables), 5), "chosen")  # the report is of these alone
    return ngrams.posts_of(ngrams.ngram_full_report(tables, chosen), chosen).drop("posted")


# --- tokens ---


@_query(f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tokens_sql('text')} AS w FROM documents)")
def tokenize_documents(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents")).select("doc_id", tokenize("text").alias("tokens"))
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@_query("SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def tokenize_documents_ascii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", tokenize_ascii(F.col("text")).alias("tokens"))
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


# --- meaning of columns ---


@_query("""SELECT * FROM (VALUES ('o_orderdate', 'datetime'), ('o_orderdate_zoned', 'datetime'), ('o_epoch', 'datetime'), ('o_orderkey', 'integer'), ('o_totalprice', 'float'),
('o_orderpriority', 'text'), ('o_link', 'url'), ('o_clock', 'time'), ('o_handle', 'identifier')) t(column_name, semantic)""")
def semantic_inference(spark, sf_dir):
    orders = _typed_orders(spark, sf_dir)
    found = semantics.infer(orders)
    return spark.createDataFrame([(c, s.type) for c, s in found.items()], "column_name string, semantic string")


def _typed_orders(spark, sf_dir) -> DataFrame:
    date = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return _table(spark, sf_dir, "orders").select(
        "o_orderdate",
        F.concat(date, F.lit(" UTC")).alias("o_orderdate_zoned"),
        (F.lit(1_600_000_000) + F.col("o_orderkey")).alias("o_epoch"),
        "o_orderkey",
        "o_totalprice",
        F.concat("o_orderpriority", F.lit(" (priority)")).alias("o_orderpriority"),
        F.concat(F.lit("https://shop.example/o/"), "o_orderkey").alias("o_link"),
        F.date_format("o_orderdate", "HH:mm").alias("o_clock"),
        F.concat(F.lit("@c"), "o_custkey").alias("o_handle"),
    )


@_query("SELECT o_orderkey, o_orderdate AS ts, make_timestamp((1600000000 + o_orderkey) * 1000000) AS epoch_ts, 'https://shop.example/o/' || o_orderkey AS link FROM orders")
def semantic_conversion(spark, sf_dir):
    orders = _typed_orders(spark, sf_dir)
    zoned, epoch = semantics.Semantic("datetime", "datetime"), semantics.Semantic("epoch_seconds", "datetime")
    return orders.select("o_orderkey", semantics.convert(F.col("o_orderdate_zoned"), zoned).alias("ts"), semantics.convert(F.col("o_epoch"), epoch).alias("epoch_ts"), semantics.convert(F.col("o_link"), semantics.Semantic("url", "url")).alias("link"))


@_query("SELECT * FROM (VALUES ('user_id', 'o_handle'), ('timestamp', 'o_orderdate'), ('price', 'o_totalprice'), ('link', 'o_link')) t(input, column_name)")
def column_automap(spark, sf_dir):
    found = {c: s.type for c, s in semantics.infer(_typed_orders(spark, sf_dir)).items()}
    wanted = (Column("user_id", "identifier", hints=("handle",)), Column("timestamp", "datetime", hints=("order date", "orderdate")), Column("price", "float", hints=("price",)), Column("link", "url"))
    return spark.createDataFrame(list(automap.automap(found, wanted).items()), "input string, column_name string")


@_query("""SELECT 'page_id' AS "column", 'bigint' AS type, 'integer' AS semantic, count(*) > 0 AS has_example FROM pages UNION ALL SELECT 'url', 'string', 'url', count(url) > 0 FROM pages UNION ALL SELECT 'html', 'string', 'text', count(html) > 0 FROM pages""")
def column_summary(spark, sf_dir):
    """Names, types, meanings and examples of a table's columns."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = [(r["column"], r["type"], r["semantic"], bool(r["example"])) for r in semantics.summarize(pages, semantics.infer(pages))]
    return spark.createDataFrame(rows, "column string, type string, semantic string, has_example boolean")


# --- tables side by side ---


@_query("""SELECT c_custkey AS key, CAST(c_acctbal AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS part FROM customer UNION ALL SELECT o_orderkey, CAST(o_custkey AS DOUBLE), o_orderpriority FROM orders""")
def stacked_tables(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("amount"), F.col("o_orderpriority").alias("part"))
    return compare.stacked([customers, orders], fill=True)


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'o_orderkey' WHEN o_orderstatus = 'F' THEN 'o_totalprice' END AS differing FROM orders WHERE o_orderkey % 10 = 3 OR o_orderstatus = 'F'")
def differing_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = orders.where("o_orderkey % 10 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return compare.differing_rows(orders, changed, ["o_orderkey"]).withColumn("differing", F.array_join("differing", ","))


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def nations_as_text(spark, sf_dir):
    return compare.as_text(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@_query("SELECT row_number() OVER (ORDER BY total_reps DESC, n_words, words) AS place, words, total_reps FROM (SELECT unnest(string_split(role, ' ')) AS words, 1 AS n_words, count(*) AS total_reps FROM conversations GROUP BY 1)")
def author_ranking(spark, sf_dir):
    """Ranks in an order of several keys."""
    roles = _table(spark, sf_dir, "conversations").select(F.explode(F.split("role", " ")).alias("words")).groupBy("words").agg(F.count(F.lit(1)).alias("total_reps"))
    return numbered(roles, "place", F.desc("total_reps"), "words").withColumn("place", F.col("place") + 1)


# --- order of the reports: ranks, so that the order itself is checked ---


@_query(f"{_NGRAMS} SELECT row_number() OVER (ORDER BY n DESC, total_reps DESC, distinct_posters DESC, words) - 1 AS place, ngram_id, words FROM summary")
def ngram_summary_order(spark, sf_dir):
    return _placed(ngrams.ngram_summary(_ngram_tables(spark, sf_dir)).select("ngram_id", "words")).select("place", "ngram_id", "words")


@_query(f"""{_NGRAMS}, r AS (SELECT *, count(*) OVER (PARTITION BY ngram_id, user_id) AS reps FROM summary JOIN x USING (ngram_id) JOIN k USING (message_surrogate_id))
SELECT row_number() OVER (ORDER BY n DESC, total_reps DESC, distinct_posters DESC, words, reps DESC, user_id, message_surrogate_id) - 1 AS place, ngram_id, message_surrogate_id FROM r""")
def ngram_full_report_order(spark, sf_dir):
    report = ngrams.ngram_full_report(_ngram_tables(spark, sf_dir))
    return _placed(report.select("ngram_id", "message_surrogate_id")).select("place", "ngram_id", "message_surrogate_id")


@_query(f"{_WINDOW_USERS}, c AS (SELECT a.user_id AS user_id_1, b.user_id AS user_id_2, count(*) AS n FROM u a JOIN u b USING (window_start) GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY n DESC, user_id_1, user_id_2) - 1 AS place, user_id_1, user_id_2 FROM c")
def coordination_order(spark, sf_dir):
    pairs = coordination.cooccurrence(_table(spark, sf_dir, "events"), "user_id", "ts")
    return _placed(pairs.select("user_id_1", "user_id_2")).select("place", "user_id_1", "user_id_2")


@_query(f"{_USES} SELECT row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS place, user_id FROM uses WHERE hashtag = '#purchase' GROUP BY user_id")
def hashtag_users_order(spark, sf_dir):
    return _placed(hashtags.tag_users(_uses(spark, sf_dir), "#purchase")).select("place", "user_id")


def _placed(df: DataFrame) -> DataFrame:
    """Rows with their places in the order in which ``df`` gives them."""
    return in_order(df, "place")


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE)::TIMESTAMP AS day, strftime(o_orderdate, '%H:%M:00') AS clock FROM orders")
def semantic_dates_and_clocks(spark, sf_dir):
    """Date strings are times at midnight; 12-hour clocks are times of day."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "hh:mm a").alias("clock"))
    found = semantics.infer(orders)
    return orders.select("o_orderkey", semantics.convert(F.col("day"), found["day"]).alias("day"), semantics.convert(F.col("clock"), found["clock"]).alias("clock"))


# --- export ---


def _exported(spark: SparkSession, df: DataFrame, kind: str, rows: int, order: str | None = None) -> str:
    """Chunks of ``rows`` rows, one file each; a pattern of their paths."""
    folder = scratch(spark, "round-trip")
    path = f"{folder}/{export_name('table', 'report')}"
    export(df, path, kind, ExportPolicy(rows), order=[order] if order else None)
    return f"{path}*.{kind}"


@_query("SELECT doc_id, source, text FROM documents")
def csv_round_trip(spark, sf_dir):
    """Texts with line breaks and quotes, written as CSV files and read back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return read_csv(spark, _exported(spark, docs, "csv", 2000), Dialect(), schema=docs.schema, empty_texts=True)


@_query("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders")
def csv_inferred(spark, sf_dir):
    """Names and types of a CSV table from its own header and rows."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    found = read_csv(spark, _exported(spark, orders, "csv", 5000))
    return found.withColumns({"o_orderkey": F.col("o_orderkey").cast("long"), "o_orderdate": F.col("o_orderdate").cast("timestamp_ntz")})


@_query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark, sf_dir):
    """Turns as files of one JSON array each, read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = importers.load(spark, _exported(spark, turns, "json", 2000, "conv_id"))
    return back.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def xlsx_round_trip(spark, sf_dir):
    """Customers as workbooks, read back."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    back = importers.load(spark, _exported(spark, customers, "xlsx", 1000, "c_custkey"))
    return back.select(*[F.col(f.name).cast(f.dataType) for f in customers.schema])


@_query("SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n_rows, min(k) AS first_key, max(k) AS last_key FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk, o_orderkey AS k FROM orders) GROUP BY 1")
def export_files(spark, sf_dir):
    """What each file of a chunked export holds."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = spark.read.parquet(_exported(spark, orders, "parquet", 1000, "o_orderkey"))
    number = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.parquet$", 1).cast("long")
    return rows.select(number.alias("chunk"), F.col("o_orderkey").alias("k")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@_query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk, o_orderkey AS \"Order\" FROM orders")
def export_chunks(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    return human_columns(with_chunks(orders, 1000, "o_orderkey"), {"o_orderkey": "Order"}).select("chunk", "Order")
