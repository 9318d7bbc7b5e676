"""Spelling variants, hard negatives and approximate neighbours against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwatch.llm import crosspolytope, negatives, queries, variants

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# --- spelling variants ---


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_counts(rows, typo_one_in):
    n = Counter()
    for id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id is None else id}:{word}".encode())
            if typo_one_in and h % typo_one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_variants(n):
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in near.items() if o}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, c, len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w, c in n.items()}


def texts():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeéÉß") for _ in range(rng.randint(4, 9))) for _ in range(25)]
    stems += ["stone" + rng.choice("xyzÿ") * k for k in range(4)]

    def bent(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abÉ") + w[k + 1 :], w, w.upper()])

    rows = [(i, ", ".join(bent(bent(rng.choice(stems))) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "12 ... 34"), (None, "Stone stone STONE stone"), rows[0], rows[0], (63, "stone×stone÷ a-stonex"), (64, "stone " * 30_000)]


@pytest.fixture(scope="module")
def words_docs(spark):
    rows = [(i, t, "x", 1) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(5).cache()


@pytest.mark.parametrize("most", [variants.MOST, 3, 0])
@pytest.mark.parametrize("one_in", [None, 7])
def test_spelling_variants(spark, words_docs, most, one_in):
    want = plain_counts(texts(), one_in)
    counts = variants.word_counts(words_docs, typo_one_in=one_in)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    got = variants.spelling_variants(counts, most=most).collect()
    assert {tuple(r) for r in got} == plain_variants(want) and len(got) == len(want)
    assert any(r["form"] and r["root"] != r["form"] for r in got) or one_in


def test_crowded_and_long_words(spark):
    """Words of one band and length, of which many differ in one letter; very long words; other scripts."""
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(300)} | {"ab" * 4 + x + y for x in "abcdefgh" for y in "abcdefgh"}
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    words |= {long, long[:77] + "z" + long[78:], long[1:], long + "a", "словарь", "словари", "словар"}
    n = {w: 3 + k % 50 for k, w in enumerate(sorted(words))}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    for most in (variants.MOST, 5):
        assert {tuple(r) for r in variants.spelling_variants(counts, most=most).collect()} == plain_variants(n)


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "a b c")], [(1, "words words")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = variants.spelling_variants(variants.word_counts(docs))
        assert out.count() == 0 and out.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_forms_lead_on(spark):
    chain = {"a" * (7 - k) + "b" * k: 3 * 2**k for k in range(7)}
    got = variants.spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r["root"] for r in got} == {"abbbbbb"} and {tuple(r) for r in got} == plain_variants(chain)


# --- hard negatives ---


def plain_negatives(rows, every, positives=5, count=3):
    kept = {}
    for id, label, e in rows:
        if id is None or label is None or not e or any(v is None or v != v or abs(v) == INF for v in e):
            continue
        row = (label, [int(np.floor(256 * v)) for v in e])
        kept[id] = min(kept.get(id, row), row)
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:positives]:
            fits = [i for i in order if kept[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits[:count])}
    return out


def labelled(n=420, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.linspace(3, 0.2, dim)
    x[n // 2 : n // 2 + 60] = x[n // 2]  # a large group of copies, in several labels
    x[10:20] = np.round(x[10:20])
    rows = [(i, int(rng.integers(0, 4)) if i % 3 else 0, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(1000, 1, None), (1001, None, rows[1][2]), (None, 1, rows[1][2]), (1002, 1, [NAN] * dim), (1003, 1, [INF] * dim), (1004, 1, [None] * dim), (1005, 2, []), (1006, 2, [0.0] * dim)]
    rows += [(2000 + i, i % 2, [float(i), 1.0]) for i in range(12)]  # another dimension
    return rows + [rows[0], (6, 0, rows[7][2]), (-12, 1, rows[3][2])]


SMALL_CELLS = [(1 << 18, 1 << 20), (200, 64)]


@pytest.mark.parametrize(("numbers", "scores"), SMALL_CELLS)
def test_hard_negatives(spark, monkeypatch, numbers, scores):
    rows = labelled()
    monkeypatch.setattr(negatives, "CELL_NUMBERS", numbers)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"rank": F.lit("x"), "windows": F.lit(1), "i": F.lit(2)}).repartition(6)
    got = [tuple(r) for r in negatives.hard_negatives(negatives.integer_rows(df), every=6, scores=scores).collect()]
    want = plain_negatives(rows, 6)
    assert set(got) == want and len(got) == len(want) and len(want) > 100


def test_search_drops_early():
    """Rows that the leading components rule out aren't scored, and none is lost."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(3000, 32)) * np.linspace(2, 0.01, 32)).astype(np.int64)
    a = x[:20]
    search = negatives.Search(negatives.fit_rotation(x.astype(float)), a, x)
    score = a @ x.T
    low, high = np.quantile(score, 0.2, axis=1).astype(np.int64)[None], np.quantile(score, 0.9, axis=1).astype(np.int64)[None]
    _, anchor, found, id = search.run(np.arange(3000), lambda lo, hi: np.ones((20, hi - lo), bool), low, high, 3)
    for i in range(20):
        fits = [j for j in np.lexsort((np.arange(3000), -score[i])) if low[0, i] <= score[i, j] <= high[0, i]][:3]
        assert id[anchor == i].tolist() == fits and found[anchor == i].tolist() == score[i, fits].tolist()
    assert search.scored < 0.25 * score.size


def test_no_negatives(spark):
    kind = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(50, 1, [1.0])], [(51, 1, [1.0]), (52, 2, [1.0])], [(50, 1, [1.0]), (51, 1, [1.0])], [(50, 1, None)]):
        out = negatives.hard_negatives(negatives.integer_rows(spark.createDataFrame(rows, kind)), every=50)
        assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    huge = spark.createDataFrame([(50, 1, [1e300]), (51, 1, [1.0]), (52, 2, [1e6])], "vec_id long, label int, embedding array<double>")
    assert negatives.integer_rows(huge).count() == 1


# --- approximate nearest neighbours ---


def plain_nearest(rows, every, k):
    kept = {}
    for id, e in rows:
        if id is None or not e or any(v is None or v != v or abs(v) == INF for v in e) or not any(e):
            continue
        kept[id] = min(kept.get(id, e), e)
    out = {}
    for q, v in kept.items():
        if q % every == 0:
            score = {i: float(crosspolytope.exact_products(np.array([v], float), np.array([w], float))[0]) for i, w in kept.items() if i != q and len(w) == len(v)}
            out[q] = [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:k]]
    return out


def vectors(n=900, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 4 * rng.normal(size=(12, dim))[rng.integers(0, 12, n)]
    x *= rng.uniform(0.2, 3, (n, 1))  # lengths differ, so the nearest by angle isn't the nearest
    x[300:500] = x[300]  # copies
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * dim), (None, rows[0][1]), (5002, [NAN] * dim), (5003, [None] * dim), (5004, [INF] * dim), (5005, [])]
    rows += [(6000 + i, [1.0, float(i % 4), 0.0]) for i in range(30)]  # another dimension, ties
    return rows + [rows[0], rows[0], (7, rows[8][1])]


@pytest.mark.parametrize("deep", [False, True])
@pytest.mark.parametrize("cell", [4096, 40])
def test_nearest_neighbours(spark, monkeypatch, deep, cell):
    rows = vectors()
    monkeypatch.setattr(crosspolytope, "CELL_ROWS", cell)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "cell": F.lit(1)}).repartition(6)
    got = crosspolytope.nearest(crosspolytope.usable_vectors(df), F.col("vec_id") % 10 == 0, k=10, deep=deep).collect()
    want = plain_nearest(rows, 10, 10)
    found: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert found.keys() == want.keys()
    hits = 0
    for q, near in found.items():
        assert len(near) == len(want[q]) and len({i for i, _ in near}) == len(near) and q not in {i for i, _ in near}
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        hits += len(set(near) & set(want[q]))
    assert hits >= 0.9 * sum(map(len, want.values()))
    one, other = ([p for p in found[q] if p[0] not in (310, 320)] for q in (310, 320))
    assert one[:8] == other[:8]  # copies ask alike


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_nearest(rows, 20, 20)
    got = queries.op13_nearest_neighbours(spark, SF).collect()
    assert len(got) == sum(map(len, want.values()))
    exact = {(q, i): s for q, near in want.items() for i, s in near}
    hits = [r for r in got if (r["query_id"], r["vec_id"]) in exact]
    assert len(hits) >= 0.9 * len(got) and all(r["score"] == exact[r["query_id"], r["vec_id"]] for r in hits)


def test_few_candidates(spark):
    kind = "vec_id long, embedding array<double>"
    ask = lambda rows: crosspolytope.nearest(crosspolytope.usable_vectors(spark.createDataFrame(rows, kind)), F.col("vec_id") % 2 == 0, k=3).collect()
    for rows in ([], [(1, [1.0])], [(2, [1.0])], [(2, None), (3, [1.0])], [(2, [0.0]), (3, [1.0])]):
        assert ask(rows) == []
    got = ask([(2, [1.0]), (3, [1.0]), (5, [-2.0]), (7, [1.0, 1.0])])
    assert [tuple(r) for r in got] == [(2, 1, 3, 1.0), (2, 2, 5, -2.0)]


def test_turns_keep_lengths_and_buckets_follow_probes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 32))
    assert np.allclose(np.linalg.norm(crosspolytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    for deep in (False, True):
        tables = crosspolytope.Tables(10, 9.0, deep=deep, probes=3)
        lifted = tables.lifted(rng.normal(size=(40, 10)), True)
        for t in range(2):
            probed = tables.probed(lifted, t)
            assert probed.shape == (40, 3) and probed.max() < tables.buckets
            # a unit vector's own bucket is the first that it would look at
            assert (probed[:, 0] == tables.assign(lifted, t)).all()
