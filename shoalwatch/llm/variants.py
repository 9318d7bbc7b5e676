"""Spelling variants of words by bands of letter-parity masks.

A word's mask has one bit for each letter that stands in it an odd number of
times. One edit changes at most two bits, so of three bands of the mask at
least one stays: words one edit apart agree in a band and differ in length by
one at most. Words are joined by band, value and length; what a join finds is
held against both masks and then checked letter by letter.

A band's value that more than ``most`` words of one length share is not
joined as a whole. Its words meet by the hashes of what is left of them after
one deletion, of which no more words than letters times places can share one;
so no value costs the square of its words, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwatch.llm.common import Scratch, drop_table, materialize
from shoalwatch.llm.textkit import mix

LETTERS = "A-Za-zÀ-ÿ"
#: Words of one length that share a band's value and are joined by it.
MOST = 2048
#: Characters of text whose words are made at once.
PIECE = 1 << 16
BANDS = 3
_U = np.uint64
#: Letters are told apart by the last eight bits of their code points; what meets
#: by chance in other scripts is checked letter by letter like all else.
_CODES = 256
_BASE = 0x9E3779B97F4A7C15
_LETTER = mix(np.arange(1, _CODES + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, typo_one_in: int | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: runs of letters of all whole texts, A-Z lower-cased, and how often they stand.

    Null and empty texts have no words, a null ``doc_id`` counts as an empty
    one, repeated rows count each. With ``typo_one_in`` a word loses a letter
    where that number divides the crc32 of ``<doc_id>:<word>``, which makes
    spelling mistakes that are the same in every run.
    """
    body = F.col(text)
    # a long text is cut behind runs of letters, so that its words aren't all held at once
    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}[{LETTERS}]*+"), F.lit(0))
    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.when(F.length(body) > PIECE, cut).otherwise(F.array(body))).alias("piece"))
    runs = rows.select("id", F.explode(F.regexp_extract_all("piece", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    word = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = runs.select("id", word.alias("word"))
    if typo_one_in:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("word", F.when(F.col("h") % typo_one_in == 0, short).otherwise(F.col("word")))
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word begins; one more at the end."""
    texts = words.to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) % _CODES
    return codes, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each letter the words in which it stands an odd number of times."""
    total = np.zeros(_CODES, np.int64)
    for batch in batches:
        codes, at = _letters(batch.column(0))
        for lo in range(0, batch.num_rows, 4096):
            hi = min(lo + 4096, batch.num_rows)
            own = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
            n = np.bincount(own * _CODES + codes[at[lo] : at[hi]], minlength=(hi - lo) * _CODES)
            total += (n.reshape(hi - lo, _CODES) & 1).sum(0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["letter", "odd"])


def deal_letters(vocabulary: DataFrame) -> np.ndarray:
    """Bands x code points: each letter's bit in its band, else 0.

    Letters are dealt in turn, those whose parity splits the words most
    evenly first, so that all bands tell words apart about as well. Only
    counts by letter reach the driver.
    """
    n = vocabulary.count()
    odd = {r["letter"]: r["odd"] for r in vocabulary.select("word").mapInArrow(_odd, "letter long, odd long").groupBy("letter").agg(F.sum("odd").alias("odd")).collect()}
    order = sorted(odd, key=lambda c: (-odd[c] * (n - odd[c]), c))
    bits = np.zeros((BANDS, _CODES), np.int64)
    for rank, letter in enumerate(order):
        turn, place = divmod(rank, BANDS)
        bits[place if turn % 2 == 0 else BANDS - 1 - place, letter] = 1 << (turn % 62)
    return bits


def _masks(bits: np.ndarray):
    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = _letters(batch.column(0))
            bands = [np.bitwise_xor.reduceat(b[codes], at[:-1]) if len(codes) else np.zeros(batch.num_rows, np.int64) for b in bits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(at), pa.int32()), *[pa.array(b, pa.int64()) for b in bands]], names=["word", "n", "size", "b0", "b1", "b2"])

    return masks


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``band, value, size, id, key``: hashes of a word without each one of its letters, or of the whole word."""
    inverse = _U(pow(_BASE, -1, 1 << 64))
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            codes, at = _letters(part.column(0))
            size = np.diff(at)
            own = np.repeat(np.arange(len(size)), size)
            power = np.full(int(size.max()) + 1, _BASE, _U)
            power[0] = 1
            power = np.multiply.accumulate(power)
            place = np.arange(len(codes)) - at[own]
            sums = np.zeros(len(codes) + 1, _U)
            np.cumsum(_LETTER[codes] * power[place], out=sums[1:])
            before, full = sums[:-1] - sums[at[own]], sums[at[1:]] - sums[at[:-1]]
            without = before + (sums[at[1:]][own] - sums[1:]) * inverse
            whole = np.asarray(part.column(5))
            some = ~whole[own]
            rows = np.concatenate((own[some], np.flatnonzero(whole)))
            keys = mix(np.concatenate((without[some], full[whole])))
            _, first = np.unique(np.stack((rows.astype(_U), keys)), axis=1, return_index=True)  # equal neighbours leave the same
            yield pa.RecordBatch.from_arrays([part.column(i).take(pa.array(rows[first])) for i in range(1, 5)] + [pa.array(keys[first].view(np.int64))], names=["band", "value", "size", "id", "key"])


_SHORT = "band int, value long, size int, id long, key long"
_OTHER = {c: f"o_{c}" for c in ("word", "n", "size", "b0", "b1", "b2", "id")}


def _linked(band: Column) -> Column:
    """Whether two words that meet by a band are one edit apart, and haven't met by an earlier one."""
    earlier = ((band > 0) & (F.col("b0") == F.col("o_b0"))) | ((band > 1) & (F.col("b1") == F.col("o_b1")))
    flips = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"o_b{k}"))) for k in range(BANDS)), F.lit(0))
    once = (F.col("size") < F.col("o_size")) | (F.col("word") < F.col("o_word"))
    return once & ~earlier & (flips <= 2) & (F.levenshtein("word", "o_word", 1) == 1)


def near_words(vocabulary: DataFrame, *, most: int = MOST) -> DataFrame:
    """``word, n, o_word, o_n``: all pairs of words one edit apart, each once.

    An edit inserts, deletes or replaces one code point. ``vocabulary`` has
    distinct words that aren't empty; it is read several times, so it should be
    a written table.
    """
    scratch = Scratch()
    masked = scratch(vocabulary.select("word", "n").mapInArrow(_masks(deal_letters(vocabulary)), "word string, n long, size int, b0 long, b1 long, b2 long").withColumn("id", F.xxhash64("word")), "masks")
    held = masked.select("*", F.posexplode(F.array("b0", "b1", "b2")).alias("band", "value"))
    key = ["band", "value", "size"]
    crowded = materialize(held.groupBy(key).count().where(F.col("count") > most).select(key), "crowded")
    # the shorter word of a pair asks, or either one of the same size
    asks = lambda df: df.withColumn("at", F.explode(F.array("size", F.col("size") + 1)))
    other = held.join(crowded, key, "left_anti").withColumnsRenamed(_OTHER).withColumnsRenamed({"band": "o_band", "value": "o_value"})
    meet = (F.col("band") == F.col("o_band")) & (F.col("value") == F.col("o_value")) & (F.col("at") == F.col("o_size"))
    few = asks(held).join(other, meet & _linked(F.col("band"))).select("word", "n", "o_word", "o_n")

    sides = held.select("word", "band", "value", "size", "id").withColumn("whole", F.lit(False))
    asking = asks(sides).withColumn("whole", F.col("at") > F.col("size")).drop("size").withColumnRenamed("at", "size").select(sides.columns)
    short = lambda df: df.join(crowded, key, "left_semi").select("word", *key, "id", "whole").mapInArrow(_shortened, _SHORT)
    met = short(asking).join(short(sides).withColumnRenamed("id", "o_id"), [*key, "key"]).select("band", "id", "o_id").where("id != o_id").distinct()
    ends = masked.withColumnsRenamed(_OTHER)
    many = met.join(masked, "id").join(ends, "o_id").where(_linked(F.col("band"))).select("word", "n", "o_word", "o_n")
    out = materialize(few.union(many), "near")
    scratch.clear()
    drop_table(crowded)
    return out


def _roots(formed: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: where their forms lead in the end.

    Each round doubles the steps taken; counts at least double with a step,
    so there are six rounds at most.
    """
    steps = materialize(formed.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "steps")
    while not steps.where("moved").isEmpty():
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        last, steps = steps, materialize(ahead, "steps")
        drop_table(last)
    return steps.select("word", "root")


def spelling_variants(counts: DataFrame, *, times: int = 2, most: int = MOST) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of all words of ``counts`` (``word, n``).

    ``n_near`` are the words one edit apart. ``form`` is the one of them that
    stands most often (ties: the smallest in code-point order), if it stands
    ``times`` times as often as the word or more. ``root`` is what the forms
    lead to, the word itself if it has none. Without words the result is
    empty.
    """
    vocabulary = materialize(counts.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(vocabulary, most=most)
    ways = F.array(F.struct("word", F.col("o_word").alias("o"), F.col("o_n").alias("m")), F.struct(F.col("o_word").alias("word"), F.col("word").alias("o"), F.col("n").alias("m")))
    both = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "o")).alias("best"))
    told = vocabulary.join(best, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.o")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    formed = materialize(told, "formed")
    drop_table(pairs)
    drop_table(vocabulary)
    return formed.join(_roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))
