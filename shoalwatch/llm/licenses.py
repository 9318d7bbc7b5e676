"""License scans by diagonal voting, on SQL functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalwatch.llm.license_texts import TEXTS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a rolling hash of phrases, and of notices.
PHRASE_K, NOTICE_K = 2, 3
#: Diagonals this close are one alignment with words put in or left out.
NEAR = 3
#: Share of a notice's k-grams that an alignment must hold.
LEAST = 0.6

#: Phrases whose every consecutive occurrence counts.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Found by alignment: short notices, and whole texts.
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    *((text, label) for label, text in TEXTS),
]


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    k: int

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER))))


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    """Phrases and notices; each needs as many words as its rolling hash."""
    made = [Template(words_of(p), label, PHRASE_K) for p, label in phrases]
    made += [Template(words_of(p), label, NOTICE_K) for p, label in notices]
    if any(t.grams < 1 for t in made):
        raise ValueError("a phrase or notice has fewer words than its rolling hash")
    return made


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + i) for i in range(k)])


def _positions(spark: SparkSession, made: list[Template]) -> DataFrame:
    rows = [(n, t.k, " ".join(t.words[i : i + t.k]), i) for n, t in enumerate(made) for i in range(t.grams)]
    return spark.createDataFrame(rows, "tid int, k int, gram string, tpos int")


def _in_order(hits: Column) -> Column:
    """The most hits whose places rise both in the text and in the template.

    Each hit takes the place of the least end of a chain that isn't below
    its own; two hits of one place in the text never stand in one chain.
    """
    placed = F.transform(F.array_sort(hits), lambda h: -h["back"])
    start = F.array().cast("array<int>")
    step = lambda ends, t: F.concat(F.filter(ends, lambda e: e < t), F.array(t), F.slice(F.filter(ends, lambda e: e >= t), 2, F.size(ends) + 1))
    return F.size(F.aggregate(placed, start, step)).cast("long")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, phrases=PHRASES, notices=NOTICES, least: float = LEAST) -> DataFrame:
    """Scan whole texts; one row per input row, other columns dropped.

    Columns: ``doc_id``, ``n_words``, ``n_base`` (places of phrases),
    ``first_word``, ``last_word`` (their smallest and largest start, from 0),
    ``base_labels``, ``labels`` (distinct, sorted, comma-joined; empty if
    none), ``score`` (1 with a phrase, else the largest held share of a
    notice, else 0), ``spans`` (label, first and last word, share). Null and
    empty texts have no words. Repeated rows are scanned each.

    Every rolling k-gram of a text is hashed and compared with the hashes of
    the templates; what is left is joined to the template positions, word by
    word equal. Hits on one diagonal (place in the text minus place in the
    template) vote for it; neighbouring diagonals merge. A phrase is found
    where one diagonal has all of its votes. The share of a notice is that
    of its k-grams which the merged diagonals hold in their order, each
    counted once; ``spans`` reach over all hits of the diagonals. Only hits and one row per
    document are shuffled, by row; a document's hits are never more than its
    words times the templates of a k-gram.
    """
    spark = df.sparkSession
    made = templates(phrases, notices)
    table = _positions(spark, made)
    hashes = {k: sorted({h[0] for h in table.where(F.col("k") == k).select(F.xxhash64("gram")).collect()}) for k in (PHRASE_K, NOTICE_K)}  # the templates' own
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    tokens = df.select(F.col(doc_id).alias("doc_id"), words.alias("w")).withColumn("n_words", F.size("w").cast("long")).withColumn("row", F.monotonically_increasing_id())

    def wanted(at: Column) -> Column:
        seen = F.lit(False)
        for k, known in hashes.items():
            if known:
                seen = seen | F.xxhash64(_gram(F.col("w"), at, k)).isin(known)
        return seen

    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), wanted)
    at = F.when(F.col("n_words") > 0, places).otherwise(F.array().cast("array<int>"))
    grams = (
        tokens.select("row", "doc_id", "n_words", "w", F.explode_outer(at).alias("pos"))
        .select("row", "doc_id", "n_words", "pos", F.explode_outer(F.when(F.col("pos").isNotNull(), F.array(*[F.struct(F.lit(k).alias("k"), _gram(F.col("w"), F.col("pos"), k).alias("gram")) for k in hashes]))).alias("g"))
        .select("row", "doc_id", "n_words", "pos", "g.k", "g.gram")
    )
    hits = grams.join(F.broadcast(table), ["k", "gram"], "left")  # bounded: the templates are parameters
    facts = spark.createDataFrame([(n, t.label, t.grams, t.k, len(t.words)) for n, t in enumerate(made)], "tid int, label string, grams int, tk int, t_words int")
    by_row = hits.repartition("row").groupBy("row", "doc_id", "n_words", "tid", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.count("tpos").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_list(F.when(F.col("tpos").isNotNull(), F.struct("pos", (-F.col("tpos")).alias("back")))).alias("hits"))
    voted = by_row.join(F.broadcast(facts), "tid", "left")
    order = Window.partitionBy("row", "doc_id", "n_words", "tid").orderBy("diag")
    apart = F.coalesce(F.col("diag") - F.lag("diag").over(order) > F.when(F.col("tk") == NOTICE_K, NEAR).otherwise(0), F.lit(True))
    merged = (
        voted.withColumn("island", F.sum(apart.cast("int")).over(order))
        .groupBy("row", "doc_id", "n_words", "tid", "island")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.flatten(F.collect_list("hits")).alias("hits"), F.first("label").alias("label"), F.first("grams").alias("grams"), F.first("tk").alias("tk"))
    )
    # no more hits stand in order than vote
    promising = (F.col("tk") == NOTICE_K) & (F.col("votes") / F.col("grams") >= least)
    merged = merged.withColumn("held", F.when(promising, _in_order(F.col("hits"))).otherwise(F.col("votes"))).drop("hits")
    share = F.least(F.lit(1.0), F.col("held") / F.col("grams"))
    exact = (F.col("tk") == PHRASE_K) & (F.col("votes") == F.col("grams"))
    aligned = (F.col("tk") == NOTICE_K) & (share >= least)
    span = F.struct("label", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + F.col("tk") - 1).cast("long").alias("last_word"), share.alias("share"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        merged.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(exact, 1)).alias("n_base"),
            F.min(F.when(exact, F.col("lo"))).cast("long").alias("first_word"),
            F.max(F.when(exact, F.col("lo"))).cast("long").alias("last_word"),
            joined(F.when(exact, F.col("label"))).alias("base_labels"),
            joined(F.when(exact | aligned, F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(exact | aligned, share)), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(exact | aligned, span))).alias("spans"),
        )
        .drop("row")
    )
