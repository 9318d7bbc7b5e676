"""The corpus pipeline against a plain version of each stage."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoalwatch.llm import bpe, lines, tiling

from test_edges_and_brute_force import brute_components, brute_runs, brute_tiles, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with nulls, blanks, numbers only, and repeated rows added."""
    path = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 -- 34\n", None, None, None), (9004, "The of and to in that is was\n", "en", None, 28)], docs.schema)
    docs.union(odd).union(docs.limit(3)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain(rows, tests):
    docs = {}
    for r in rows:  # rows that share an id are copies here
        docs[r["doc_id"]] = r["text"]
    docs = {i: t for i, t in docs.items() if t and any(map(str.isalpha, t))}

    sets = {i: shingles(t) for i, t in docs.items()}
    linked = [(a, b) for a in docs for b in docs if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = brute_components(sorted(docs), linked)
    docs = {i: t for i, t in docs.items() if label[i] == i}

    runs, cut = brute_runs(list(docs.items()), lines.MIN_SIZE), {}
    for i, t in docs.items():
        left, place = "", 0
        for _, lo, hi, _ in runs.get((i, t), []):
            left, place = left + t[place:lo], hi + 1
        left += t[place:]
        if left.strip() or (i, t) not in runs:
            cut[i] = left

    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    tests = [word(t["text"]) for t in tests]
    clean = {}
    for i, t in cut.items():
        words, grams = word(t), {}
        for p in range(len(words) - tiling.MATCH + 1):
            grams.setdefault(tuple(words[p : p + tiling.MATCH]), []).append(p)
        held = False
        for test in tests:
            if any(tuple(test[k : k + tiling.MATCH]) in grams for k in range(len(test) - tiling.MATCH + 1)):
                held |= sum(n for *_, n in brute_tiles(words, test, tiling.MATCH)) >= tiling.COVERAGE * len(test)
        if not held:
            clean[i] = t
    return clean


def test_pipeline(spark, tables):
    want = plain(spark.read.parquet(f"{tables}/documents.parquet").collect(), spark.read.parquet(f"{tables}/benchmark.parquet").collect())
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert set(out) == set(want)
    own = bpe.encoding()
    for i, r in out.items():
        ids = own.encode_ordinary(want[i])
        assert r["round_trip"] and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_columns_and_stand_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
        assert stage(spark, empty, tables).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, tables).count() == 0


def test_null_rows_pass_the_later_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(5)
    none = docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.unionByName(none), tables).where("doc_id is null").count() >= 1
