"""Tokens and n-grams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shoalwatch.functions import tokenizers
from shoalwatch.functions.ngrams import ngrams
from shoalwatch.functions.tokenizer import TokenizerConfig, tokenize, tokenize_text
from shoalwatch.operators.ngrams import ngram_full_report, ngram_summary, ngram_tables, search, top


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Quick! The ferry leaves at noon.", "quick the ferry leaves at noon".split()),
        ("山川草木", list("山川草木")),
        ("كتب الولد رسالة", "كتب الولد رسالة".split()),
        ("ขอบคุณ", list("ขอบคุณ")),
        ("바다와 하늘", ["바다와", "하늘"]),
        ("Android폰 화면이 밝다", ["android", "폰", "화면이", "밝다"]),
        ("?!&%~", ["?!&%~"]),
        ("row7\tseat9\ngate3", ["row", "7", "seat", "9", "gate", "3"]),
        (" \t ", []),
        ("", []),
        (None, []),
        ("Both v.i.p.s came late", ["both", "v.i.p.s", "came", "late"]),
        ("born in the U.K. in May", ["born", "in", "the", "u.k.", "in", "may"]),
        ("see page.two.b. then", ["see", "page.two", "b", "then"]),
        ("a well-known ex-pilot aged forty-two", ["a", "well-known", "ex-pilot", "aged", "forty-two"]),
        ("7 3.14 2nd 10,000 9,876,543 €20 15%", ["7", "3.14", "2nd", "10,000", "9,876,543", "€20", "15%"]),
        ("$XYZ fell to $9 again", ["$xyz", "fell", "to", "$9", "again"]),
        ("read http://a.example/b?c=2); thanks", ["read", "http://a.example/b?c=2", "thanks"]),
        ("read http://a.example/@b.); thanks", ["read", "http://a.example/@b.);", "thanks"]),
        ("Добрый день", ["добрый день"]),
        ("naïve", ["na", "ve"]),
        ("#天気 と @友人", ["#", *"天気", "と", "@", *"友人"]),
    ],
)
def test_default_tokens(text, tokens):
    assert tokenize_text(text) == tokens


def test_configurations():
    post = "Ask @ana about #rain on http://wx.example 🌧"
    assert tokenize_text(post, TokenizerConfig(extract_hashtags=False, include_emoji=True)) == "ask @ana about rain on http://wx.example 🌧".split()
    assert tokenize_text("open http://b.example soon", TokenizerConfig(include_urls=False)) == ["open", "soon"]
    assert tokenize_text("write to ana@wx.example today", TokenizerConfig(include_urls=False, include_emails=False))[-1] == "today"
    assert tokenize_text("sold 30 at 4.5%", TokenizerConfig(include_numeric=False)) == ["sold", "at"]
    assert tokenize_text("He is an old sailor", TokenizerConfig(min_token_length=3)) == ["old", "sailor"]
    assert tokenize_text("tiny enormous", TokenizerConfig(max_token_length=4)) == ["tiny"]
    assert tokenize_text("C d", TokenizerConfig(case="preserve")) == ["C", "d"]
    assert tokenize_text("C d", TokenizerConfig(case="upper")) == ["C", "D"]
    assert tokenize_text("c; d?", TokenizerConfig(include_punctuation=True)) == ["c", ";", "d", "?"]
    assert tokenize_text("ﬂag", TokenizerConfig(normalize_unicode=True)) == ["flag"]
    assert len(tokenize_text("sea " * 100_000)) == 100_000


def test_column(spark):
    df = spark.createDataFrame([("Good night",), (None,)], "t string")
    assert [r[0] for r in df.select(tokenize("t")).collect()] == [["good", "night"], []]


@pytest.mark.parametrize(("low", "high", "n"), [(1, 3, 18), (5, 7, 6), (5, 8, 6), (3, 2, 0), (8, 9, 0)])
def test_ngram_counts(spark, low, high, n):
    words = "the small boat drifts past grey cliffs".split()
    out = spark.createDataFrame([(words,)], "w array<string>").select(ngrams(F.col("w"), low, high).alias("g")).first()["g"]
    assert len(out) == n
    if (low, high) == (5, 8):
        assert [g["words"] for g in out[:2]] == ["the small boat drifts past", "the small boat drifts past grey"]


POSTS = [
    ("u1", "m1", "row row row now we're all wet", 1),
    ("u2", "m2", "Row row row, we're all wet. we're all wet", 2),
    ("u1", "m3", "row row row row", 3),
    ("u3", "m4", "", 4),
    (None, "m5", "row row row", 5),
]


@pytest.mark.parametrize("exact", [True, False])
def test_repeated_phrases(spark, exact):
    posts = spark.createDataFrame(POSTS, "user_id string, message_id string, message_text string, timestamp long")
    tables = ngram_tables(posts, min_n=3, max_n=4, exact_ids=exact)
    summary = ngram_summary(tables)
    rows = {r["words"]: r for r in summary.collect()}
    assert (rows["row row row"]["total_reps"], rows["row row row"]["distinct_posters"]) == (3, 2)
    assert rows["we're all wet"]["total_reps"] == 2
    assert all(r["total_reps"] > 1 for r in rows.values())
    full = ngram_full_report(tables, summary).where("words = 'row row row'").collect()
    assert sorted((r["user_id"], r["reps_per_user"]) for r in full) == [("u1", 2), ("u1", 2), ("u2", 1)]
    if exact:
        assert sorted(r["message_surrogate_id"] for r in tables.message_authors.collect()) == [1, 2, 3]
        assert tables.ngrams.where("words = 'row row row'").first()["ngram_id"] == 0
    assert top(summary, 1).first()["words"] == "row row row"
    assert search(summary, "all").count() == 1 + summary.where("words like '% all %' and words != \"we're all wet\"").count()
    assert search(summary, "al").count() == 0 and search(summary, None, []).count() == 0
    assert search(summary, "row.").count() == 0


def test_no_ngrams(spark):
    posts = spark.createDataFrame([("u", "m", "one", 1)], "user_id string, message_id string, message_text string, timestamp long")
    tables = ngram_tables(posts)
    assert tables.ngrams.count() == 0 and ngram_full_report(tables).count() == 0


#: A text, and its tokens with bars between them.
_CASES = [
    ("Late again: the 7th tram, 45 min!", "late|again|the|7th|tram|45|min"),
    ("Ask @ana or #help at http://wx.example/a?b=1).", "ask|@ana|or|#help|at|http://wx.example/a?b=1"),
    ("The U.K. and e.u. don't re-open", "the|u.k.|and|e.u.|don't|re-open"),
    ("$XYZ up 2.5% to €1,200", "$xyz|up|2.5|to|€1,200"),
    ("山川 and 바다 or كتب", "山|川|and|바다|or|كتب"),
    ("ขอบ", "ข|อ|บ"),
    ("Добрый день", "добрый день"),
    ("naïve ﬂag", "na|ve|ag"),
    (" ", ""),
]


def test_fixed_cases(spark):
    rows = spark.createDataFrame([(text,) for text, _ in _CASES], "text string")
    got = rows.select("text", F.array_join(tokenize("text"), "|").alias("tokens")).collect()
    assert {r["text"]: r["tokens"] for r in got} == dict(_CASES)


def test_tokenizers_plug_in(spark):
    class Letters:
        """Anything with a name and a column is a tokenizer."""

        name = "letters"

        def column(self, text):
            return F.filter(F.split(text, ""), lambda c: c != "")

    tokenizers.register(Letters())
    tokenizers.register(tokenizers.TextTokenizer("backwards", lambda text: text.split()[::-1]))
    posts = spark.createDataFrame([("u", "m1", "ab cd ef", 1), ("v", "m2", "ab cd ef", 2), ("v", "m3", None, 3)], "user_id string, message_id string, message_text string, timestamp long")
    words = lambda t: {r["words"] for r in ngram_summary(ngram_tables(posts, tokenizer=t, min_n=3, max_n=3)).collect()}
    assert words("analysis") == words("spaced") == {"ab cd ef"} and words("backwards") == {"ef cd ab"}
    assert words(tokenizers.get("letters")) == {"a b  ", "b   c", "  c d", "c d  ", "d   e", "  e f"}
    for name in ("basic", "ascii", "spaced", "backwards"):
        column = tokenizers.get(name).column(F.col("message_text"))
        assert [r[0] for r in posts.orderBy("message_id").select(column).collect()][2] == []
    assert tokenizers.register_sql(spark, "backwards") == "tokens_backwards"
    posts.createOrReplaceTempView("posts_to_cut")
    got = spark.sql("SELECT message_id, t.place, t.token FROM posts_to_cut, LATERAL tokens_backwards(message_text) t").collect()
    assert {tuple(r) for r in got} == {(m, i, w) for m in ("m1", "m2") for i, w in enumerate(["ef", "cd", "ab"])}
    with pytest.raises(ValueError, match="no tokenizer"):
        tokenizers.get("none")
    with pytest.raises(ValueError, match="column"):
        tokenizers.register_sql(spark, "ascii")
    with pytest.raises(TypeError):
        tokenizers.register("spaced")
