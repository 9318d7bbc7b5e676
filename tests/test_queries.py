"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from shoalwatch import registry
from shoalwatch.functions.tokenizer import tokenize_text
from shoalwatch.operators.ngrams import ANALYSIS

SF = "/root/testdata/sf0.001"


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x != x:
            return "null"
        return repr(round(float(x), 9)) if isinstance(x, float) else str(x)

    columns = sorted(df.columns)
    return sorted(tuple(map(plain, row)) for row in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        want = tables.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)


def test_ngrams_of_all_scripts(spark, tmp_path):
    turns = [(1, 1, "user", "一二三四 #tag @you"), (1, 2, "bot", "一二三四"), (2, 1, "user", "See #tag @you now"), (2, 2, "user", "see #tag @you later")]
    turns += [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id > 2").collect()]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    posters = defaultdict(list)
    for _, _, role, text in turns:
        words = tokenize_text(text, ANALYSIS) if text and role else []
        for gram in {(" ".join(words[i : i + n]), n) for n in (3, 4, 5) for i in range(len(words) - n + 1)}:
            posters[gram].append(role)
    want = {(*gram, len(p), len(set(p))) for gram, p in posters.items() if len(p) > 1}
    got = registry.QUERIES["ngram_summary_all_scripts"](spark, str(tmp_path)).collect()
    assert {(r["words"], r["n"], r["total_reps"], r["distinct_posters"]) for r in got} == want and len(got) == len(want)
    assert {("一 二 三 四", 4, 2, 2), ("see #tag @you", 3, 2, 1)} <= want


def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
