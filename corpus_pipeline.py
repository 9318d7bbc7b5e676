"""Corpus cleaning pipeline over the training-data operators.

Every stage takes an empty table and gives an empty one, takes null and
repeated ids, and lets columns of any other name pass, those included that an
operator's own results are named like (they keep the documents' values). The
last stage alone has columns of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwatch.llm import bpe, langid, lines, minhash, tiling
from shoalwatch.llm.common import materialize
from shoalwatch.session import spread

#: Bytes of texts that Spark hands to Python at once. A task holds a batch several
#: times over, in Spark, in Arrow and in Python.
BATCH_BYTES = 4 << 20
#: A document stays if its strongest language has this proportion at least.
DOMINANT = 0.3


def _small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes; documents differ too much in length for a count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, or of a mixture that no language leads.

    Null and blank texts have no letters and go. A language that was never
    learnt gets a learnt one and stays. Copies are judged alike; of languages
    with equal proportions the first by name leads. Where no text has a
    language, none can be learnt, and all documents go.
    """
    _small_batches(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    told = langid.with_language(docs, model)
    return langid.dominant_only(told, DOMINANT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each near-duplicate group.

    Null texts and texts without words are near to nothing and stay. Of rows
    that share an id one stays, that of the smallest hash of the text; rows
    with a null id all stay.
    """
    _small_batches(spark)
    return minhash.without_near_duplicates(docs).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document, or an earlier place, has already.

    Documents rank by id (null last), then by a hash of the text. One of
    which nothing stays is dropped; null and blank texts that lost nothing
    stay. ``n_chars`` follows the text.
    """
    _small_batches(spark)
    cut = lines.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items.

    Null texts hold none and stay; null and empty items are in no document.
    Copies go together.
    """
    _small_batches(spark)
    return tiling.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to its bytes.

    A null text is encoded as an empty one. One row a document, repeated ones
    included.
    """
    _small_batches(spark)
    return bpe.with_round_trip(docs.select("doc_id", "lang", "source", "text")).select(
        "doc_id",
        "lang",
        "source",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.coalesce(F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.lit(False)).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("line_dedup", drop_repeated_lines),
    ("decontamination", decontaminate),
    ("bpe_encode", encode),
]

#: No stage but the third can be said in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
