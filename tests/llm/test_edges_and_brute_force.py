"""Each operator against brute force, and its edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from shoalwatch.llm import bpe, langid, licenses, lines, minhash, queries, suffixes, textkit, tiling, token_counts, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use inside.
CLASHING = ["_id", "_text", "_hash", "_gone", "hash", "gone", "s_rate", "f_depth", "_told", "_suffix", "_salt", "key", "rep", "at", "n", "m"]
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, n, rng=RNG):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def corpus():
    """Copies, near copies, a shared passage, nulls, blanks, repeated rows, a long text."""
    rng = random.Random(11)
    base, passage = prose(120, rng), prose(60, rng)
    texts = [base, base, base.upper(), "", None, "  \n\t ", "one two", "one two", "one two three four five", prose(20000, rng)]
    texts += [edited(base, k % 7, rng) for k in range(30)]
    texts += [f"{passage}\n{prose(k % 12, rng)}" for k in range(40)]
    texts += [prose(rng.randint(1, 80), rng) for _ in range(60)]
    texts += ["a" * 700, "ab" * 300, "é\x00ü" * 90, passage + " " + passage]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[3], (None, base, "en", "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with those of the results
    return spark.createDataFrame(corpus(), DOCS).withColumn("n_tokens", F.lit("x")).withColumn("score", F.lit("y")).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    kinds = ["http://A.example.com/en/7x", "https://example.net/de/8?x=1", "ftp://x.org/es/#f", "example.com/en/", None, "", "://", "http://com/en/", "http://notcom/en/", "http://b.com?en/", "http://É.COM/en/y\nz", "http://x.org/fr/1"]
    more = [f"http://h{i}.{tld}/{lang}/{i}" for i in range(40) for tld in ("com", "net", "org") for lang in ("en", "de", "es", "fr")]
    rows = [(i, u) for i, u in enumerate(kinds + more + kinds[:2])]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit(1)), queries.RULES).collect()
    assert len(out) == len(rows)
    url = dict(rows)
    for r in out:
        host, path = brute_host_path(url[r["page_id"]])
        fits = [x for x in queries.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.pattern), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.pattern)
        assert r["verdict"] == (best.verdict if best else "block" if r["block_margin"] > 0 else "allow")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), queries.RULES).count() == 0
    only = urls.judge(spark.createDataFrame([(1, "http://a.zz/")], "page_id long, url string"), queries.RULES).first()
    assert only["verdict"] == "allow"


def test_urls_held_out(spark):
    rows = [(f"http://h{i}.{'bad' if i % 2 else 'good'}/{i}" + ("?a=1&b=2" if i % 2 else ""), i % 2) for i in range(400)]
    model = urls.train(spark.createDataFrame(rows[:200], "url string, label int"))
    scored = urls.with_features(spark.createDataFrame(rows[200:], "url string, label int"), "url", model.suffixes, model.prior)
    right = scored.agg(F.avg(((model.margin > 0).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.95
    # the expression is the fitted trees' own answer
    features = VectorAssembler(inputCols=urls.FEATURES, outputCol="features").transform(scored.withColumn("margin", model.margin))
    for r in model.trees.transform(features).collect():
        assert r["margin"] == pytest.approx(r["rawPrediction"][1]) and (r["margin"] > 0) == (r["prediction"] == 1)


@pytest.mark.parametrize("most", [0, urls.BROADCAST_BYTES])
def test_url_suffixes_of_all_labelled(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", most)
    rows = [(f"http://h{i}.s{i % 50}/p{i % 7}", int(i % 50 % 3 == 0)) for i in range(400)]
    model = urls.train(spark.createDataFrame(rows + rows[:100], "url string, label int"), sample=40)
    told = [f"http://new.s{i}/" for i in range(51)]
    scored = urls.with_features(spark.createDataFrame([(u,) for u in told + told], "url string"), "url", model.suffixes, model.prior).collect()
    prior = sum(label for _, label in rows) / 400
    want = {u: ((8 * (i % 3 == 0) + prior) / 9, 8.0) if i < 50 else (prior, 0.0) for i, u in enumerate(told)}
    assert len(scored) == 102 and "_salt" not in scored[0]
    assert all((r["f_suffix_rate"], r["f_suffix_count"]) == pytest.approx(want[r["url"]]) for r in scored)


# --- 2 ---


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_near_duplicates(docs, percent):
    rows = [r for r in corpus() if r[0] is not None]
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = brute_components(ids, linked)
    out = minhash.near_duplicates(docs, percent=percent).collect()
    assert len(out) == len(corpus())
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_many_with_one_passage(spark, monkeypatch):
    """Groups over the pair limit and over one block; texts mostly of one passage."""
    monkeypatch.setattr(minhash, "CELL_MEMBERS", 8)
    rng = random.Random(5)
    passage = prose(50, rng)
    rows = [(i, passage + " " + prose(rng.randint(1, 14), rng)) for i in range(60)]
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = brute_components(list(sets), linked)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == label


def test_near_duplicates_empty_and_repeated(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(two).collect()} == {(1, 1), (2, 1)}
    assert minhash.without_near_duplicates(two).count() == 1


def test_agreement_and_tables_follow_the_similarity():
    for percent in range(40, 100, 5):
        wide, half = minhash.banding(percent)
        assert 2 * wide * half == 32
        least, s = minhash.least_agreement(percent), percent / 100
        below = [sum(math.comb(32, k) * s**k * (1 - s) ** (32 - k) for k in range(n)) for n in (least, least + 1)]
        assert below[0] <= minhash.AGREE_MISS < below[1]


def test_one_row_of_an_id_stays(spark):
    rows = [(1, "a b c d e f", "x"), (1, "q r s t u v", "y"), (1, "q r s t u v", "z"), (2, "other words are in this text", "v"), (None, "a b c d e f", "w"), (None, None, "u"), (3, None, "t"), (4, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").coalesce(1)
    out = [tuple(r) for r in minhash.without_near_duplicates(df).collect()]
    assert len(out) == 6 and {r[2] for r in out} >= set("vwuts")
    assert out.count((1, "q r s t u v", "z")) == 0  # of equal rows the first read stays


@pytest.mark.parametrize(
    "apply",
    [
        lambda df, _: urls.judge(df.withColumn("url", F.concat(F.lit("http://a.b/"), "text")), queries.RULES).drop("url", "host", "path", "rule", "verdict", "block_margin"),
        lambda df, _: minhash.without_near_duplicates(df),
        lambda df, _: lines.without_repeats(df),
        lambda df, tests: tiling.without_contaminated(df, tests),
        lambda df, _: bpe.with_round_trip(df).drop("token_ids", "decoded"),
        lambda df, _: langid.with_language(df, langid.train(df, lang="rep")).drop("lang_pred", "score", "lang_mix"),
    ],
)
def test_clashing_names_pass_through(spark, apply):
    rows = [(i, f"text number {i} of these") for i in range(5)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in CLASHING})
    out = apply(df, spark.createDataFrame([(1, "no such test item here")], "item_id long, text string"))
    assert sorted(out.columns) == sorted(df.columns)
    assert {tuple(r[n] for n in CLASHING) for r in out.collect()} == {tuple(CLASHING)}
    assert out.count() == 6


# --- 3 ---


def test_probes_reach_pairs_of_the_lowest_similarity():
    """Random directions, the hardest for lists; 60 lists and pairs right at the similarity."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cosine in (0.9, 0.8):
        c = vectors._kmeans(x, 60)
        probes = vectors._probes(x, c, cosine)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
        far, home = vectors._distances(x, c), vectors._nearest(y, c)
        rank = (far < far[np.arange(len(x)), home][:, None]).sum(1)
        assert (rank < probes).mean() >= 0.998


@pytest.mark.parametrize("per_list", [vectors.PER_LIST, 8])
def test_vectors(spark, monkeypatch, per_list):
    monkeypatch.setattr(vectors, "PER_LIST", per_list)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [base[i % 60] + rng.normal(size=16) * 0.1 * (i % 4) for i in range(400)] + [base[0]] * 30 + [base[1] * 7]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(rows)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1.0, 0.0]), (909, [5.0]), (910, [1.0]), (None, data[0][1])]
    out = vectors.near_duplicates(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x")).repartition(4)).collect()
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    label = brute_components(list(range(len(rows))), [(int(a), int(b)) for a, b in np.argwhere(np.triu(near, 1))])
    assert len(out) == len(data) + len(odd)
    for r in out:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None and not r["kept"]
        elif r["vec_id"] in (906, 907, 909, 910):  # each dimension links within itself
            low = 906 if r["vec_id"] < 909 else 909
            assert (r["n_links"], r["component_id"], r["kept"]) == (1, low, r["vec_id"] == low)
        elif r["vec_id"] >= 900:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
        else:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (near[i].sum() - 1, label[i], label[i] == i)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 4 and 9 ---


def test_bpe(docs, empty):
    own = bpe.encoding()
    want = sorted(((r[0], own.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in corpus()), key=str)
    out = bpe.with_decoded(bpe.with_token_ids(docs, keep=["doc_id"])).collect()
    got = sorted(((r["doc_id"], np.frombuffer(r["token_ids"], "<u4").tolist(), bytes(r["decoded"])) for r in out), key=str)
    assert got == want
    once = bpe.with_round_trip(docs, keep=["doc_id"]).collect()
    assert sorted(((r["doc_id"], np.frombuffer(r["token_ids"], "<u4").tolist(), bytes(r["decoded"])) for r in once), key=str) == want
    assert bpe.with_token_ids(empty).count() == 0


def test_long_texts_are_split_where_the_pattern_splits(monkeypatch):
    own = bpe.encoding()
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    for text in [prose(300), "x" * 400, " " * 300 + "a", "don't\n\n  stop 12'll  a" * 40, "é ü\n" * 200, "a \n b  \n\n" * 60]:
        assert "".join(bpe.pieces(text, 50)) == text
        assert bpe.encode(text).tolist() == own.encode_ordinary(text)


def test_token_counts(docs, empty, spark):
    own = bpe.encoding()
    lengths = [len(own.encode_ordinary(r[1] or "")) for r in corpus()]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs)).cache()
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["docs_up_to"] == sum(x <= n for x in lengths)
        assert r["total_tokens"] == sum(lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["cut_docs"] == sum(x > n for x in lengths)
    limits = spark.createDataFrame([(n,) for n in (0, 1, 7, 100, 10**7)], "limit long")
    for r in token_counts.truncated_totals(sums, limits).collect():
        assert r["truncated_total"] == sum(min(x, r["limit"]) for x in lengths)
    assert token_counts.truncated_totals(sums, limits).count() == 5
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0


# --- 5 ---


def test_tiling(spark, empty):
    rng = random.Random(9)
    tests = [(i, prose(30, rng)) for i in range(8)] + [(8, None), (9, "too short"), (None, prose(20, rng))]
    words = [t.split() if t else [] for _, t in tests]
    reordered = " ".join(words[1][15:] + ["mid", "dle"] + words[1][:15])
    rows = [(0, prose(200, rng)), (1, prose(50, rng) + " " + tests[0][1].upper() + ", " + prose(9, rng)), (2, reordered), (3, None), (4, ""), (5, " ".join(words[2][:10])), (6, (tests[3][1] + " ") * 50), (1, tests[4][1])]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    out = tiling.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_matched"], r["n_tiles"]) for r in out) == [(1, 0, 30, 1), (1, 4, 30, 1), (2, 1, 30, 2), (6, 3, 30, 1)]
    assert tiling.contaminated(empty, bench).count() == 0
    assert tiling.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench.where("false")).count() == 0
    clean = tiling.without_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [0, 3, 4, 5]
    blocks = tiling.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=200).collect()
    assert sorted(blocks) == sorted(out)


def test_tiling_null_ids_short_items_and_passages(spark):
    rng = random.Random(10)
    long, nameless = prose(500, rng), prose(20, rng)
    bench = spark.createDataFrame([(None, nameless), (1, "Who was É?"), (2, long), (3, "the"), (4, " ?! ")], "item_id long, text string")
    cut = lambda n: " ".join(long.split()[100 : 100 + n])
    texts = [f"x {nameless} y", "a b\n- who was É\nc", "we ask who was É in the prose", "who\nwas é", "Who\nwas É!\n", cut(50), cut(49), f"z {cut(249)}", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tests in (bench, bench.where("item_id = 1")):
        out = tiling.contaminated(docs, tests).select("doc_id", "item_id", "n_matched", "n_item", "first_word", "last_word").collect()
        want = [(0, None, 20, 20, 1, 20), (1, 1, 3, 3, 2, 4), (4, 1, 3, 3, 0, 2), (5, 2, 50, 500, 0, 49), (7, 2, 249, 500, 1, 249)]
        assert sorted(map(tuple, out)) == [w for w in want if tests is bench or w[1] == 1]
    assert sorted(r["doc_id"] for r in tiling.without_contaminated(docs, bench).collect()) == [2, 3, 6, 8, 9]


def test_tiling_of_long_texts(spark):
    rng = random.Random(13)
    item, other = prose(40, rng), "la " * 60
    texts = [prose(60_000, rng) + " " + item + " " + prose(60_000, rng), prose(120_000, rng), "x" * 2_000_000 + " " + item, "la " * 20_000]
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    out = tiling.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in out) == [(0, 1, 40), (2, 1, 40), (3, 2, 60)]


def test_rolling_hashes_tell_runs_apart():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 4, size=3000).astype(np.uint64)
    got = textkit.rolling_hashes(textkit.mix(words), 5)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    assert len(got) == len(runs) and len(set(zip(runs, got.tolist()))) == len(set(runs)) == len(set(got.tolist()))
    assert len(textkit.rolling_hashes(textkit.mix(words[:4]), 5)) == 0


def brute_tiles(text, test, match):
    """Plain greedy string tiling over words."""
    free_text, free_test, tiles = [True] * len(text), [True] * len(test), []
    while True:
        best = None
        for t in range(len(test)):
            for p in range(len(text)):
                n = 0
                while t + n < len(test) and p + n < len(text) and text[p + n] == test[t + n] and free_text[p + n] and free_test[t + n]:
                    n += 1
                if n >= match and (best is None or n > best[0]):
                    best = (n, t, p)
        if best is None:
            return tiles
        n, t, p = best
        free_test[t : t + n] = [False] * n
        free_text[p : p + n] = [False] * n
        tiles.append((p, t, n))


def test_tiles_are_greedy():
    rng = random.Random(4)
    for _ in range(60):
        text, test = [rng.choice("ab") for _ in range(40)], [rng.choice("ab") for _ in range(15)]
        hits = [(p, t) for p in range(38) for t in range(13) if text[p : p + 3] == test[t : t + 3]]
        places, tests_at = (np.array([h[i] for h in hits], np.int64) for i in (0, 1))
        got = tiling.tile(places, tests_at, 15, 3)
        assert sum(x[2] for x in got) == sum(x[2] for x in brute_tiles(text, test, 3))
        assert got == brute_tiles(text, test, 3)


# --- 6 ---


def brute_units(text):
    """(start, end, size, words of the digest, own words with sizes), by a plain reading of the rule."""
    text = text or ""
    stops = [i for i, c in enumerate(text) if c in "\n\x1e。！？" or c in " \t" and (text[i - 1 : i] in (".", "!", "?") or unicodedata.category(text[i + 1 : i + 2] or " ") == "Lu")]
    found, words = [], []
    for lo, hi in zip([0, *(i + 1 for i in stops)], [*stops, len(text)]):
        mine = re.findall("[^\t-\r ]+", text[lo:hi])
        if mine:
            found.append((lo, hi, len(words), len(mine)))
            words += mine
    unspaced = lambda w: sum(any(a <= ord(c) <= b for a, b in lines.UNSPACED) for c in w)
    size = [max(1, len(w) // 8, unspaced(w) // 2) for w in words]
    out = []
    for lo, hi, at, n in found:
        reach = n
        while at + reach < len(words) and sum(size[at : at + reach]) < lines.REACH:
            reach += 1
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words[at : at + reach]]
        out.append((lo, hi, sum(size[at : at + n]), " ".join(low), list(zip(low, size[at : at + n]))))
    return out


def equal_size(one, other):
    """Size of the equal words of two sequences of words, up to the first that differ."""
    total = 0
    for (w, size), (v, _) in zip(one, other):
        if w != v:
            break
        total += size
    return total


def brute_runs(rows, least):
    """{(doc_id, text): [(unit, start, end, size)]} of runs of units that occur earlier."""
    seen, runs = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        units = brute_units(text)
        now, mine = [], []
        for u, (lo, hi, size, words, _) in enumerate([*units, (0, 0, 0, None, None)]):
            if words in seen and words is not None:
                now.append((u, lo, hi, size, seen[words]))
                continue
            seen[words] = units, u
            if now:
                total = around = sum(x[3] for x in now)
                (there, at), (u0, *_) = now[0][4], now[0]
                if u0 and at:
                    around += equal_size(units[u0 - 1][4][::-1], there[at - 1][4][::-1])
                there, at = now[-1][4]
                if u < len(units) and at + 1 < len(there):
                    around += equal_size(units[u][4], there[at + 1][4])
                if around >= least:
                    mine.append((now[0][0], now[0][1], now[-1][2], total))
            now = []
        if mine:
            runs[doc, text] = mine
    return runs


def sentences(n, rng):
    return " ".join(prose(rng.randint(1, 12), rng).capitalize() + rng.choice([".", ".", "!", "?", ""]) for _ in range(n))


def passages():
    """Texts with one passage in lines, sentences, and amid words; short lines that repeat; long and odd texts."""
    rng = random.Random(8)
    passage, footer = sentences(9, rng), "All rights reserved. Printed in Ulm."
    rows = [(i, f"{sentences(4, rng)}\n{footer}") for i in range(20)]
    rows += [(20 + i, f"{prose(i, rng)} {passage} {prose(7 - i, rng)}\n{footer}\n") for i in range(8)]
    rows += [(28 + i, f"{sentences(2, rng)}{rng.choice(['\n', ' ', chr(30), '。'])}{passage}") for i in range(8)]
    rows += [(36, passage), (37, passage.upper()), (38, passage + "\n" + passage), (39, sentences(3000, rng)), (40, None), (41, ""), (42, " \n\t "), (43, "É\x00Ä" * 300), (None, passage)]
    torn = " ".join(sentences(20, rng).split()[3:48])  # begins and ends amid sentences
    rows += [(44 + i, f"{sentences(3, rng)} so {prose(i + 1, rng)} {torn} {prose(5 - i, rng)}.") for i in range(4)]
    return rows + [rows[-1], rows[36], rows[0], rows[40]]


@pytest.mark.parametrize("least", [1, 40])
def test_lines(spark, empty, least):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in CLASHING}).repartition(4)
    want = brute_runs(rows, least)
    got = collections.defaultdict(list)
    texts = dict(rows)
    for r in lines.repeated_runs(df, min_size=least).collect():
        got[r["doc_id"], texts[r["doc_id"]]].append((r["unit"], r["start"], r["end"], r["size"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert lines.repeated_runs(empty, min_size=least).count() == 0
    left = lines.without_repeats(df, min_size=least)
    assert left.columns == df.columns and lines.without_repeats(empty).count() == 0
    kept = collections.Counter()
    for doc, text in rows:
        short, place = "", 0
        for _, lo, hi, _ in want.get((doc, text), []):
            short, place = short + text[place:lo], hi + 1
        short = text if text is None else short + text[place:]
        if (doc, text) not in want or short.strip():
            kept[doc, short] += 1
    assert collections.Counter((r["doc_id"], r["text"]) for r in left.collect()) == kept
    assert {r[n] for r in left.collect() for n in CLASHING} == set(CLASHING)


def test_passage_goes_and_short_lines_stay():
    runs = brute_runs(passages(), 40)
    assert {d for d, _ in runs} == {*range(21, 37), 38, 45, 46, 47, None}  # in 37 each capital begins a unit
    rest = [t for (d, t) in runs if d in range(21, 28)]
    assert all("All rights reserved" in t[hi:] for t in rest for *_, hi, _ in runs[next(d for d, x in runs if x == t), t])


def test_units_without_ascii_spaces():
    for text in ["版权所有，未经书面许可不得转载。本网站的任何内容", "このサイトの内容を無断で転載することを禁じます", "สงวนลิขสิทธิ์ห้ามคัดลอกเนื้อหา", "all\u00a0rights\u00a0reserved", "QUJD" * 40, "http://example.com/" + "a/" * 40, "A", " ", "。", "a.b c. D"]:
        u = lines.cut_units(text)
        assert list(zip(u.starts, u.ends, u.sizes)) == [x[:3] for x in brute_units(text)]


def test_long_texts_are_cut_in_parts(monkeypatch):
    rng = random.Random(2)
    texts = [sentences(400, rng), sentences(3, rng), None, sentences(90, rng) + "\n", prose(3000, rng), "é。" * 500, sentences(200, rng)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(range(len(texts)), pa.int64())], names=["doc_id", "text", "text_hash"])
    found = lambda: sorted((r for b in lines._find([batch]) for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["unit"]))
    whole = found()
    for size in (50, 333, 2000):
        monkeypatch.setattr(lines, "PART_CHARS", size)
        assert found() == whole
    assert [(r["start"], r["end"], r["size"]) for r in whole if r["doc_id"] == 0] == [x[:3] for x in brute_units(texts[0])]


# --- 7 ---


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_licenses(spark, empty):
    texts = [None, "", "MIT License", "the GNU  General\nPublic-License; mit license, MIT LICENSE", "gnu general public", "cc by cc by cc", "apache licenses", prose(400) + " Apache License",
             "Permission is hereby granted, free of charge, to any human person obtaining a copy of this software and associated documentation files", "licensed under cc by-nc 4.0", "mit\x00license é", "x " * 5000 + "mit license"]
    rows = [(i, t) for i, t in enumerate(texts + texts[2:4])]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1)).repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        n, places = brute_phrases(rows[r["doc_id"]][1])
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = ",".join(sorted({p[1] for p in places}))
        assert r["base_labels"] == base
        assert set(base.split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in out}
    assert labels[8] == "mit" and labels[9] == "cc-by,cc-by-nc"
    assert licenses.scan(empty).count() == 0


def test_notices_are_verified(spark):
    def most_in_order(words, template):
        best = [0] * (len(template) + 1)  # longest common subsequence of k-grams
        for i in range(len(words) - 2):
            before = list(best)
            for t in range(len(template) - 2):
                best[t + 1] = max(best[t], before[t + 1], before[t] + 1 if words[i : i + 3] == template[t : t + 3] else 0)
        return best[len(template) - 2]

    bsd = next(n for n, label in licenses.NOTICES if label == "bsd").split()  # holds no phrase
    part, noise = bsd[:9] + ["so", "to", "say"] + bsd[9:], "and binary forms "
    texts = ["creative commons attribution " * 7, "the terms of " * 18, noise * 18, " ".join(bsd[10:] + bsd[:10]), " ".join(bsd), " ".join(part), noise * 5 + " ".join(bsd), " ".join(bsd * 2)]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i]["labels"] for i in range(8)] == [""] * 4 + ["bsd"] * 4
    for i, text in enumerate(texts[2:], 2):
        share = most_in_order(text.split(), bsd) / (len(bsd) - 2)
        assert out[i]["score"] == pytest.approx(share if share >= licenses.LEAST else 0)


def test_whole_licence_texts(spark):
    rng = random.Random(12)
    texts = [t for _, t in licenses.TEXTS]
    changed = [" ".join(w for i, w in enumerate(t.split()) if i % 9) for t in texts]  # one word in nine is missing
    around = [f"{prose(30, rng)} {t} {prose(30, rng)}" for t in texts]
    rows = list(enumerate(texts + changed + around + [prose(300, rng), texts[1].split(". ")[2]]))
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(texts)
    for i, (label, text) in enumerate(licenses.TEXTS):
        for r in (out[i], out[n + i], out[2 * n + i]):
            assert label in r["labels"].split(",")
        assert out[i]["score"] == out[2 * n + i]["score"] == 1
        whole = max((s["last_word"] - s["first_word"] + 1, s["first_word"]) for s in out[2 * n + i]["spans"] if s["label"] == label)
        assert abs(whole[0] - len(licenses.words_of(text))) <= 2 * licenses.NEAR and abs(whole[1] - 30) <= licenses.NEAR
    assert out[3 * n]["labels"] == out[3 * n + 1]["labels"] == ""  # a sentence of a text is not the text


# --- 8 ---


def test_mixtures_against_plain_em():
    """Every set of languages, each by plain EM run to the end."""
    rng = np.random.default_rng(6)
    table = rng.dirichlet(np.full(langid.BUCKETS, 0.02), size=3) + 1e-6
    logp = np.log(table / table.sum(axis=1, keepdims=True))
    model = langid.LanguageModel(["aa", "bb", "cc"], logp)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüéñ "))
    for k in range(40):
        text = "".join(rng.choice(letters, size=int(rng.integers(3, 400))))
        if not langid.has_letter(text):
            continue
        counts = langid.ngram_counts(text)
        values = np.flatnonzero(counts)
        counts = counts[values]
        best = None
        for chosen in ([0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]):
            p, w = np.exp(logp[chosen][:, values]), np.full(len(chosen), 1 / len(chosen))
            for _ in range(3000):
                w = w * (p @ (counts / (w @ p))) / counts.sum()
            score = counts @ np.log(w @ p) - len(chosen) * 0.5 * np.log(counts.sum())
            if best is None or score > best[0]:
                best = score, dict(zip((model.languages[c] for c in chosen), w))
        lang, share, shares = model.mixture(text)
        own = counts @ np.log(sum(w * np.exp(logp[model.languages.index(name)][values]) for name, w in shares.items())) - len(shares) * 0.5 * np.log(counts.sum())
        assert own == pytest.approx(best[0], abs=max(0.05, 1e-4 * abs(best[0])))
        if set(shares) == set(best[1]):
            assert all(abs(shares[n] - w) < 0.03 for n, w in best[1].items())
            assert share == pytest.approx(max(best[1].values()), abs=0.03) and (best[1][lang] > max(best[1].values()) - 0.05)


def test_ngrams_of_pieces_are_those_of_the_text(monkeypatch):
    rng = random.Random(14)
    texts = ["a", "  ", "ab  cd", "É é1 2", "x" * 50, "".join(rng.choice("ab É.\n ") for _ in range(500)), prose(200, rng)]
    whole = [langid.ngram_counts(t) for t in texts]
    spaced = " " + re.sub("[^a-z]+", " ", texts[-1]) + " "
    assert whole[-1].sum() == 2 * len(spaced) - 3 and whole[0].sum() == 3
    for size in (2, 3, 7, 40):
        monkeypatch.setattr(langid, "PIECE_CHARS", size)
        assert all((langid.ngram_counts(t) == w).all() for t, w in zip(texts, whole))


def test_language_of_long_and_repeated_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    long = " ".join(r["text"] for r in docs.where("lang = 'de'").limit(60).collect()) * 8
    rows = [(0, long), (0, long), (1, "x" * 300_000), (2, "é " * 100_000)]
    told = langid.with_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(long) > 200_000 and [r["lang_pred"] for r in told if r["doc_id"] == 0] == ["de", "de"]
    assert len({(r["score"], str(r["lang_mix"])) for r in told if r["doc_id"] == 0}) == 1 and len(told) == 4




def test_language(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    model = langid.train(docs.where("doc_id % 2 = 0"))
    texts = {r["lang"]: r["text"] for r in docs.where("doc_id % 2 = 1 and length(text) > 2000").collect()}
    both = texts["en"][:2000] + " " + texts["de"][:1000]
    rows = [(0, None), (1, ""), (2, "12 34 !?"), (3, both), (4, texts["fr"]), (5, "日本語")]
    told = {r["doc_id"]: r for r in langid.with_language(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), model).collect()}
    assert [told[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and told[0]["score"] == 0
    assert told[3]["lang_pred"] == "en" and set(told[3]["lang_mix"]) == {"en", "de"} and 0.55 < told[3]["score"] < 0.8
    assert told[4]["lang_pred"] == "fr" and told[4]["score"] > 0.9
    assert told[5]["lang_pred"] in model.languages
    assert langid.train(empty).languages == []
    assert langid.with_language(empty, model).count() == 0


# --- 10 ---


def test_similarities_that_tables_find_too_seldom():
    assert minhash.banding(85) == (2, 8) and minhash.banding(38) == (1, 16)
    with pytest.raises(ValueError, match="higher"):
        minhash.banding(30)


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        yield len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 64, 4096), (60, 24, 4096), (40, 16, 2)])
def test_suffixes(docs, empty, monkeypatch, length, gram, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    want = sorted(brute_repeats([r[1] for r in corpus()], length))
    out = suffixes.remove_repeats(docs, length=length, gram=gram, keep_bytes=True).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == want
    for r in out:
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"] == r["n_bytes"] - sum(b - a for a, b in r["spans"])
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffixes_of_several_blocks(spark):
    """Blocks within one partition, and a text larger than a block."""
    rng = random.Random(17)
    shared = [prose(60, rng) for _ in range(6)]
    texts = ["".join(rng.choice([prose(30, rng), rng.choice(shared)]) for _ in range(n)) for n in [400] * 8 + [7000]]
    assert sum(map(len, texts)) > 2 * suffixes.BLOCK_BYTES and len(texts[-1]) > suffixes.BLOCK_BYTES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = suffixes.remove_repeats(df, length=60, gram=24).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == sorted(brute_repeats(texts, 60))


def test_spans_across_segments(monkeypatch):
    rng = np.random.default_rng(1)
    part = rng.integers(97, 100, 700).astype(np.uint8)
    data = np.concatenate((part, rng.integers(97, 100, 900).astype(np.uint8), part))
    whole = suffixes.spans(data, np.array([len(data)]), 50, 16)
    monkeypatch.setattr(suffixes, "SEGMENT", 256)
    cut = suffixes.spans(data, np.array([len(data)]), 50, 16)
    keys = lambda s: np.repeat(s["key"], s["n"])[np.argsort(np.concatenate([np.arange(p, p + n) for p, n in zip(s["place"], s["n"])]))]
    assert (keys(whole) == keys(cut)).all() and len(keys(whole)) == len(data) - 49


def test_pointers_tell_windows_apart():
    rng = np.random.default_rng(9)
    for length, gram in ((200, 64), (130, 64), (128, 64), (64, 64), (40, 16)):
        part = rng.integers(97, 99, size=40).astype(np.uint8)
        data = np.tile(part, 30)
        data[rng.integers(len(data), size=6)] = 120
        windows = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        found = list(zip(*(suffixes.pointers(data, w, length, gram).tolist() for w in (0, 1))))
        assert len(found) == len(windows) and len(set(zip(windows, found))) == len(set(windows)) == len(set(found))


def test_refinement_finds_equal_windows():
    rng = np.random.default_rng(0)
    for alphabet in (1, 2, 3, 200):
        data = rng.integers(0, alphabet, 900).astype(np.uint8)
        starts = np.arange(len(data) - 40)
        count = collections.Counter(bytes(data[s : s + 40]) for s in starts)
        assert suffixes.repeated_windows(data, starts, 40).tolist() == [count[bytes(data[s : s + 40])] > 1 for s in starts]
