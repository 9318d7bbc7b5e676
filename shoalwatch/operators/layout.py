"""Report tables laid out for drill-downs: by word in buckets, by key in ranges."""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass
from typing import Any

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwatch.operators.ngrams import search
from shoalwatch.session import scratch

#: What stands between the search's word borders, for Spark and for Python.
_RUN = r"(?U)\w+"
_RUNS = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200C\u200D]+")
BUCKETS, FILES = 64, 64


#: Small letters that share their capital with another small letter, which stands for them.
_TWINS = {c: c.upper().lower() for c in map(chr, range(1 << 16)) if c.lower() == c and len(c.upper()) == 1 and len(c.upper().lower()) == 1 and c.upper().lower() != c}


def _key(text: Column) -> Column:
    """One text for all texts that differ in case alone, as the search takes them."""
    lowered = F.lower(F.translate(text, "İ", "i"))
    return F.translate(lowered, "".join(_TWINS), "".join(_TWINS.values()))


@dataclass
class WordIndex:
    """A bucketed table of n-grams by each of their words; dropped when the process ends."""

    table: str
    source: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.source.sparkSession.table(self.table)

    def search(self, term: str | None = None, lengths: list[int] | None = None) -> DataFrame:
        """The same rows as ``search`` of the indexed table, from the bucket of one word of the term.

        A term without a word, or no term, is searched in the table itself.
        """
        words = _RUNS.findall(term or "")
        if not words:
            return search(self.source, term, lengths)
        # the longest word is likely the rarest
        word = max(words, key=lambda w: (len(w), w))
        return search(self.rows.where(F.col("word__of") == _key(F.lit(word))).drop("word__of"), term, lengths)


def index_words(summary: DataFrame, words: str = "words", *, buckets: int = BUCKETS) -> WordIndex:
    """Write ``summary`` once for each distinct word of ``words``, bucketed and sorted by it.

    Rows carry all columns, so a search joins nothing. A word of many
    n-grams is one bucket's, as its search returns them all.
    """
    spark = summary.sparkSession
    name = f"words_{uuid.uuid4().hex}"
    each = F.explode(F.array_distinct(F.regexp_extract_all(_key(F.col(words)), F.lit(_RUN), F.lit(0)))).alias("word__of")
    folder = scratch(spark, "word-index")
    summary.select("*", each).repartition(buckets, "word__of").write.format("parquet").bucketBy(buckets, "word__of").sortBy("word__of").option("path", folder).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return WordIndex(name, summary)


def _drop(spark, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the JVM is gone at exit, and its catalog with it
        return


@dataclass
class Clustered:
    """A table in files by ranges of its keys, and the least and greatest keys of each file."""

    folder: str
    table: DataFrame
    keys: tuple[str, ...]
    #: file, and for each key the least and the greatest value; one row a file
    bounds: list[tuple]

    def files(self, **wanted: Any) -> list[int]:
        """Files that can hold rows of the wanted keys: a value, or a pair of ends for a range; null for all."""
        out = []
        for part, *ends in self.bounds:
            least, most = ends[: len(self.keys)], ends[len(self.keys) :]
            if all(_meets(value, least[self.keys.index(k)], most[self.keys.index(k)]) for k, value in wanted.items()):
                out.append(part)
        return out

    def where(self, **wanted: Any) -> DataFrame:
        """Rows of the wanted keys; other files aren't opened."""
        rows = self.table.where(F.col(_FILE).isin(self.files(**wanted)))
        for k, value in wanted.items():
            if value is not None:
                rows = rows.where(_fits(F.col(f"`{k}`"), value))
        return rows.drop(_FILE)


_FILE = "file__of"


def _meets(value: Any, least: Any, most: Any) -> bool:
    if value is None:
        return True
    low, high = value if isinstance(value, tuple) else (value, value)
    return least is not None and low <= most and least <= high


def _fits(column: Column, value: Any) -> Column:
    return column.between(*value) if isinstance(value, tuple) else column == value


def clustered(df: DataFrame, *keys: str, files: int = FILES) -> Clustered:
    """Write ``df`` in ``files`` ranges of ``keys``, sorted within.

    The ranges are of about equal numbers of rows; a value that many rows
    have is cut by the keys behind it. The bounds, one row a file, are held
    by the driver.
    """
    spark = df.sparkSession
    folder = scratch(spark, "clustered")
    cut = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).withColumn(_FILE, F.spark_partition_id())
    cut.write.partitionBy(_FILE).parquet(folder)
    table = spark.read.schema(cut.schema).parquet(folder)
    ends = [F.min(f"`{k}`").alias(f"least_{i}") for i, k in enumerate(keys)] + [F.max(f"`{k}`").alias(f"most_{i}") for i, k in enumerate(keys)]
    bounds = [tuple(r) for r in table.groupBy(_FILE).agg(*ends).collect()]  # one row a file
    return Clustered(folder, table, keys, bounds)
