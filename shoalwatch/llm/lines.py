"""Substring dedup by hashing lines, paragraphs and sentences.

A text is cut into units at line breaks, at white space after the end of a
sentence or before a capital letter, and at full stops of scripts without
spaces. Units are grouped by digest over the corpus; consecutive units that
occur earlier make a run, and a run goes if it is long enough with the equal
words around it. So a passage is found wherever it was put into a line, and
short lines that many documents share stay. A short unit's digest reaches
into the words after it, so that neither names nor one-word sentences repeat
by chance.
"""

from __future__ import annotations

import functools
import re
import string
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwatch.llm.common import Scratch, internal, materialize
from shoalwatch.llm.textkit import U, mix

#: A run of repeated units goes if it has this size at least with the equal words around it, see ``Units``.
MIN_SIZE = 40
#: The digest of a unit covers words of this size in all, where the text has them.
REACH = 5
#: Characters of texts that are cut at once; longer texts come in parts.
PART_CHARS = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Line feed, record separator, ideographic full stop, full-width ! and ?
_BREAKS = (0x0A, 0x1E, 0x3002, 0xFF01, 0xFF1F)
#: Scripts that don't part words: Thai to Tibetan, Myanmar, Khmer, kana,
#: bopomofo, Han; as first and last code points.
UNSPACED = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
_SAFE = re.compile("\n|(?<=[.!?])[ \t]")
_WORD = r"[^\x09-\x0D\x1E\x20\u3002\uFF01\uFF1F]+"
_DENSE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED) + "]"
_NEXT = re.compile(r"(?:\s*[^\s]+){0,%d}\s?" % REACH)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: a random odd code of its lower-cased letter, and its kind."""
    n = sys.maxunicode + 1
    lower = np.arange(n, dtype=np.uint64)
    lower[65:91] += U(32)
    kind = np.zeros(n, np.uint8)
    kind[list(range(9, 14)) + [32]] = 1
    for first, last in UNSPACED:
        kind[first : last + 1] = 2
    kind[[c for c in range(n) if unicodedata.category(chr(c)) == "Lu"]] = 3
    kind[list(_BREAKS)] = 4
    return mix((lower + U(1)) * U(_BASES[0])) | U(1), kind


@functools.lru_cache(maxsize=4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hashes of the parts of ``codes`` from ``starts`` to ``ends``."""
    power, inverse = _powers(which, 1 << max(19, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


@dataclass
class Units:
    """Units of some text, in order; those without words are left out.

    ``starts`` and ``ends`` in characters. Words are runs without white space
    and breaks; a word has the size 1, or an eighth of its characters if that
    is more, or half of its characters in scripts that don't part words.
    ``h1, h2`` are digests of the unit's words, A-Z lower-cased, and of the
    words after it until ``REACH`` is reached.
    """

    starts: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def cut_units(text: str, borders: np.ndarray | None = None) -> Units:
    """``borders`` are the places where joined texts begin, each after a line feed."""
    codes, kinds = _tables()
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(x)
    kind = kinds[x]
    stop = kind == 4
    blank = (x == 32) | (x == 9)
    parts = np.zeros(n, bool)
    parts[:-1] = kind[1:] == 3
    parts[1:] |= (x[:-1] == 46) | (x[:-1] == 33) | (x[:-1] == 63)
    stop |= blank & parts
    inside = ~(stop | (kind == 1))
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    words, word_ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    if not len(words):
        none = np.empty(0, np.int64)
        return Units(none, none, none, none, none.astype(np.int32))
    number = np.cumsum(stop)[words]
    first = np.flatnonzero(np.diff(number, prepend=-1))
    last = np.append(first[1:], len(words))
    dense = np.concatenate(([0], np.cumsum(kind == 2)))
    weight = np.maximum(np.maximum(1, (word_ends - words) // 8), (dense[word_ends] - dense[words]) // 2)
    weighed = np.concatenate(([0], np.cumsum(weight)))
    # words up to the end of the own text
    limit = np.full(len(first), len(words))
    if borders is not None:
        upto = np.append(np.searchsorted(words, borders[1:]), len(words))
        limit = upto[np.searchsorted(borders, words[first], "right") - 1]
    reach = np.minimum(limit, np.maximum(last, np.searchsorted(weighed, weighed[first] + REACH)))
    own = _hashes(codes[x], words, word_ends, 0)
    # a unit reaches to the breaks around it
    breaks = np.flatnonzero(stop)
    k = number[first]
    starts = np.concatenate(([0], breaks + 1))[k]
    ends = np.append(breaks, n)[k]
    return Units(starts, ends, weighed[last] - weighed[first], _hashes(own, first, reach, 0).view(np.int64), (_hashes(own, first, reach, 1) >> U(32)).astype(np.uint32).view(np.int32))


def _parts(text: str) -> Iterator[tuple[int, int, str]]:
    """A long text in parts that end with a break: start, size, and the part with the next words."""
    at = 0
    while len(text) - at > PART_CHARS:
        place = _SAFE.search(text, at + PART_CHARS)
        if place is None:
            break
        end = place.start() + 1
        yield at, end - at, text[at : _NEXT.match(text, end).end()]
        at = end
    yield at, len(text) - at, text[at:]


_FOUND = "doc_id long, text_hash long, unit int, start long, end long, size int, h1 long, h2 int"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of ``doc_id, text, text_hash``, texts joined up to ``PART_CHARS``."""

    def told(rows: list[tuple[int | None, int, int, int, int]], text: str, size: int | None = None) -> pa.RecordBatch:
        # rows: doc_id, hash, units before, place of ``text`` in the whole text, place of the row in ``text``
        borders = np.array([r[4] for r in rows])
        u = cut_units(text, borders)
        if size is not None:
            mine = u.starts < size
            u = Units(u.starts[mine], u.ends[mine], u.sizes[mine], u.h1[mine], u.h2[mine])
        row = np.searchsorted(borders, u.starts, "right") - 1
        count = np.arange(len(row)) - np.searchsorted(row, row) + np.array([r[2] for r in rows], np.int64)[row]
        shift = np.array([r[3] for r in rows], np.int64)[row] - borders[row]
        doc = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(row))
        text_hash = pa.array([r[1] for r in rows], pa.int64()).take(pa.array(row))
        columns = [doc, text_hash, pa.array(count, pa.int32()), pa.array(u.starts + shift, pa.int64()), pa.array(u.ends + shift, pa.int64()), pa.array(u.sizes, pa.int32()), pa.array(u.h1), pa.array(u.h2)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "unit", "start", "end", "size", "h1", "h2"])

    for batch in batches:
        rows: list[tuple] = []
        texts: list[str] = []
        held = 0
        for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns)):
            if not text:
                continue
            if len(text) > PART_CHARS:
                before = 0
                for at, size, part in _parts(text):
                    out = told([(doc_id, text_hash, before, at, 0)], part, size)
                    before += len(out)
                    yield out
                continue
            if held + len(text) > PART_CHARS:
                yield told(rows, "\n".join(texts))
                rows, texts, held = [], [], 0
            rows.append((doc_id, text_hash, 0, 0, held))
            texts.append(text)
            held += len(text) + 1
        if rows:
            yield told(rows, "\n".join(texts))


def repeated_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_size: int = MIN_SIZE) -> DataFrame:
    """Runs of units to remove: each unit has an earlier ranked occurrence.

    Columns: ``doc_id, text_hash, unit`` (number of the run's first unit in
    its text, from 0), ``start, end`` (characters of the original text),
    ``n_units, size`` (see ``Units``), ``kept_doc_id, kept_unit`` (the first
    occurrence of the run's first unit, which stays), ``copies`` (of that
    unit, in all).

    Occurrences rank by doc_id (null last), hash of the text, and unit; the
    earliest of a unit never goes. A passage may begin and end amid units, so
    the words of the units around a run that stand there in the first
    occurrence too count as well: runs smaller than ``min_size`` with them
    stay. Only whole units go. Null and empty texts, and texts of white space
    only, have no units. Rows equal in doc_id and text are one document and
    get the same runs removed. An empty table gives an empty result; other
    columns are not read.

    Digests have 96 bits. Counts are merged before the shuffle, and a unit
    that a third of all documents hold is a skewed join, which Spark splits.
    Only repeated units are gathered by document.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    scratch = Scratch()
    units = scratch(docs.mapInArrow(_find, _FOUND), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "unit")
    groups = units.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = units.join(scratch(groups, "groups").hint("merge"), ["h1", "h2"]).where(rank != F.col("first"))
    again = again.select("doc_id", "text_hash", "unit", "start", "end", "size", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.text_hash").alias("kept_text"), F.col("first.unit").alias("kept_unit"), "copies")
    again = scratch(again, "repeated").repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "unit"])
    order = Window.partitionBy("doc_id", "text_hash").orderBy("unit")
    runs = again.withColumn("run", F.col("unit") - F.row_number().over(order)).groupBy("doc_id", "text_hash", "run")
    head = F.min_by(F.struct("kept_doc_id", "kept_text", "kept_unit", "copies"), "unit").alias("head")
    tail = F.max_by(F.struct("kept_doc_id", "kept_text", "kept_unit"), "unit").alias("tail")
    runs = scratch(runs.agg(F.min("unit").alias("unit"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("size").alias("size"), head, tail), "all-runs")
    short = runs.where(F.col("size") < min_size)
    around = _around(short, units, docs, min_size, scratch)
    grown = short.join(around.hint("merge"), _same(short, around)).where(F.col("size") + F.col("around") >= min_size).select(*[short[c] for c in short.columns])
    kept = runs.where(F.col("size") >= min_size).unionByName(grown)
    found = materialize(kept.select("doc_id", "text_hash", "unit", "start", "end", "n_units", "size", "head.kept_doc_id", "head.kept_unit", "head.copies"), "runs")
    scratch.clear()
    return found


def _same(a: DataFrame, b: DataFrame, prefix: str = "at_") -> Column:
    """Whether rows of ``a`` and ``b`` are one unit; ids may be null."""
    return a["doc_id"].eqNullSafe(b[prefix + "doc_id"]) & (a["text_hash"] == b[prefix + "text_hash"]) & (a["unit"] == b[prefix + "unit"])


def _around(runs: DataFrame, units: DataFrame, docs: DataFrame, min_size: int, scratch: Scratch) -> DataFrame:
    """``at_doc_id, at_text_hash, at_unit, around``: size of the words right before and after a run that stand around its first occurrence too.

    Runs that the whole units around them would not bring to ``min_size``
    are left out, so only few texts are read again.
    """
    side = lambda name, doc, text, unit, own: F.struct(F.lit(name).alias("side"), own.alias("unit"), F.col(doc).alias("kept_doc_id"), F.col(text).alias("kept_text"), unit.cast("int").alias("kept_unit"))
    before = side("before", "head.kept_doc_id", "head.kept_text", F.col("head.kept_unit") - 1, (F.col("unit") - 1).cast("int"))
    after = side("after", "tail.kept_doc_id", "tail.kept_text", F.col("tail.kept_unit") + 1, (F.col("unit") + F.col("n_units")).cast("int"))
    asked = runs.select("doc_id", "text_hash", F.col("unit").alias("run"), F.col("size").alias("inside"), F.explode(F.array(before, after)).alias("b"))
    asked = asked.select("doc_id", "text_hash", "run", "inside", "b.*").where("unit >= 0 and kept_unit >= 0")
    own = units.select(F.col("doc_id").alias("at_doc_id"), F.col("text_hash").alias("at_text_hash"), F.col("unit").alias("at_unit"), F.col("size").alias("at_size"))
    sized = asked.join(own.hint("merge"), _same(asked, own)).select(*[asked[c] for c in asked.columns], "at_size").dropDuplicates(["doc_id", "text_hash", "run", "side"])
    most = F.sum("at_size").over(Window.partitionBy("doc_id", "text_hash", "run"))
    asked = scratch(sized.withColumn("most", F.col("inside") + most).where(F.col("most") >= min_size).drop("most", "at_size", "inside"), "borders")

    wanted = asked.select("doc_id", "text_hash", "unit").union(asked.select("kept_doc_id", "kept_text", "kept_unit")).distinct()
    spans = units.select(*[F.col(c).alias("at_" + c) for c in ("doc_id", "text_hash", "unit")], "start", "end")
    spans = wanted.join(spans.hint("merge"), _same(wanted, spans)).select("doc_id", "text_hash", "unit", "start", "end").distinct()
    per_doc = spans.groupBy(F.col("doc_id").alias("in_doc"), F.col("text_hash").alias("in_text")).agg(F.collect_list(F.struct("unit", "start", "end")).alias("spans"))
    texts = docs.join(per_doc.hint("merge"), docs["doc_id"].eqNullSafe(per_doc["in_doc"]) & (docs["text_hash"] == per_doc["in_text"])).select("doc_id", "text_hash", "text", F.explode("spans").alias("s"))
    part = F.expr("substring(text, cast(s.start + 1 as int), cast(s.end - s.start as int))")
    lowered = F.translate(part, string.ascii_uppercase, string.ascii_lowercase)
    words = scratch(texts.select("doc_id", "text_hash", F.col("s.unit").alias("unit"), F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0)).alias("words")).distinct(), "border-words")

    mine = words.select(*[F.col(c).alias("at_" + c) for c in ("doc_id", "text_hash", "unit", "words")])
    theirs = words.select(*[F.col(c).alias("kept_at_" + c) for c in ("doc_id", "text_hash", "unit", "words")])
    both = asked.join(mine.hint("merge"), _same(asked, mine))
    first = both["kept_doc_id"].eqNullSafe(theirs["kept_at_doc_id"]) & (both["kept_text"] == theirs["kept_at_text_hash"]) & (both["kept_unit"] == theirs["kept_at_unit"])
    both = both.join(theirs.hint("merge"), first)
    toward = lambda c: F.when(F.col("side") == "before", F.reverse(c)).otherwise(F.col(c))
    both = both.select("doc_id", "text_hash", "run", toward("at_words").alias("a"), toward("kept_at_words").alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    equal = F.slice("a", F.lit(1), F.when(differ == 0, F.size("a")).otherwise((differ - 1).cast("int")))
    weight = lambda w: F.greatest(F.lit(1), F.floor(F.length(w) / 8), F.floor((F.length(w) - F.length(F.regexp_replace(w, _DENSE, ""))) / 2))
    told = both.groupBy("doc_id", "text_hash", "run").agg(F.sum(F.aggregate(equal, F.lit(0).cast("long"), lambda n, w: n + weight(w))).alias("around"))
    return told.select(F.col("doc_id").alias("at_doc_id"), F.col("text_hash").alias("at_text_hash"), F.col("run").alias("at_unit"), "around")


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_size: int = MIN_SIZE) -> DataFrame:
    """All columns of ``df`` with repeated runs cut out of ``text``.

    The character after a run (the break that ends its last unit) goes too.
    Documents of which nothing but white space stays are dropped if they
    lost something; all others stay, null texts and ids included. Columns of
    any name pass through. The runs are joined by shuffle at every size, as
    they grow with the corpus.
    """
    gone, key_id, key_text, own = internal(df, "gone", "key_id", "key_text", "hash")
    runs = repeated_runs(df, doc_id, text, min_size=min_size)
    per_doc = runs.groupBy(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_text)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(gone))
    same = (F.col(own) == F.col(key_text)) & F.col(doc_id).cast("long").eqNullSafe(F.col(key_id))
    joined = df.withColumn(own, F.xxhash64(text)).join(per_doc.hint("merge"), same, "left").select(*df.columns, gone)
    names, at, last = df.columns, df.columns.index(text), len(df.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_of = batch.column(last)
            columns = batch.columns[:last]
            if runs_of.null_count < len(batch):
                texts, keep = [], []
                for whole, cuts in zip(columns[at], runs_of):
                    if not cuts.is_valid:
                        texts.append(whole.as_py())
                        keep.append(True)
                        continue
                    left, place = [], 0
                    whole = whole.as_py()
                    for span in cuts.as_py():
                        left.append(whole[place : span["start"]])
                        place = span["end"] + 1
                    texts.append("".join(left) + whole[place:])
                    keep.append(bool(texts[-1].strip()))
                columns[at] = pa.array(texts, columns[at].type)
                batch = pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))
                yield batch
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return joined.mapInArrow(cut, schema)
