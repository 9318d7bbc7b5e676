"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwatch.llm import textkit
from shoalwatch.llm.common import internal, materialize

#: Words of the shortest match that counts, and of a seed.
MATCH = 5
#: Share of a test's words that tiles must cover.
COVERAGE = 0.5
#: Words of a tile that counts whatever share of the test it is.
PASSAGE = 50
#: Bytes of test texts that are held at once; more are taken in blocks.
BLOCK_BYTES = 32 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass
class Tests:
    """A bounded block of test items and the sorted hashes of their seeds."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: items too short for a seed, by their words
    short: dict[tuple[bytes, ...], list[int]]


def index_tests(ids: list, texts: list[str], match: int = MATCH) -> Tests:
    words = []
    for _, w in textkit.words(pa.array(texts, pa.string()), textkit.ALNUM):
        words += [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    grams = [textkit.rolling_hashes(w, match) for w in words]
    seeds = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
    order = np.argsort(seeds, kind="stable")
    short: dict[tuple[bytes, ...], list[int]] = {}
    for i, w in enumerate(words):
        if 0 < len(w) < match:
            short.setdefault(_first_words(texts[i].encode(), match), []).append(i)
    return Tests(np.array(ids, object), words, seeds[order], item[order], place[order], short)


def _first_words(text: bytes, n: int) -> tuple[bytes, ...]:
    return tuple(m[0].lower() for m in islice(_WORD.finditer(text), n))


def _short_items(tests: Tests, text: str, match: int) -> Iterator[tuple]:
    """Short items that are the whole text or one of its lines, at their first place."""
    whole, at, found = text.encode(), 0, {}
    for line in [whole, *whole.split(b"\n")]:
        words = _first_words(line, match)
        if words in tests.short and words not in found:
            found[words] = 0 if line is whole else len(_WORD.findall(whole[:at]))
        at += 0 if line is whole else len(line) + 1
    for words, first in found.items():
        for item in tests.short[words]:
            n = len(words)
            yield tests.ids[item], 1.0, 1, n, n, first, first + n - 1


def _runs(places: np.ndarray, tests_at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal runs of seeds on one diagonal: text place, test place, seeds."""
    diagonal = places - tests_at
    order = np.lexsort((places, diagonal))
    d, p, t = diagonal[order], places[order], tests_at[order]
    breaks = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) != 1)) + 1
    for lo, hi in zip(np.concatenate(([0], breaks)).tolist(), np.concatenate((breaks, [len(p)])).tolist()):
        yield int(p[lo]), int(t[lo]), hi - lo


def tile(places: np.ndarray, tests_at: np.ndarray, n_test: int, match: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (text place, test place, words) from seed hits.

    Takes the longest match whose words are free on both sides, again and
    again, down to ``match`` words; ties go to the earlier place in the test,
    then in the text. A match that lost words to a tile competes again with
    the free runs that are left of it.
    """
    heap = [(-(n + match - 1), t, p) for p, t, n in _runs(places, tests_at)]
    heapq.heapify(heap)
    in_test = np.zeros(n_test, bool)
    in_text: set[int] = set()
    tiles = []
    while heap and not in_test.all():
        size, t, p = heapq.heappop(heap)
        free = [not in_test[t + i] and p + i not in in_text for i in range(-size)]
        if all(free):
            in_test[t : t - size] = True
            in_text.update(range(p, p - size))
            tiles.append((p, t, -size))
            continue
        start = None
        for i, f in enumerate([*free, False]):
            if f and start is None:
                start = i
            elif not f and start is not None:
                if i - start >= match:
                    heapq.heappush(heap, (start - i, t + start, p + start))
                start = None
    return tiles


def contaminated(
    df: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", *, test_id: str = "item_id", test_text: str = "text", match: int = MATCH, coverage: float = COVERAGE, passage: int = PASSAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Pairs of a document and a test item that its text covers enough.

    Enough is a share of ``coverage``, or one tile of ``passage`` words.

    Columns: ``doc_id, text_hash, item_id, coverage`` (share of the item's words under
    tiles), ``n_tiles, n_matched, n_item`` (words), ``first_word, last_word``
    (of the text, from 0). Words are runs of ASCII letters, digits and bytes
    that are not ASCII, A-Z lower-cased.

    Seeds are running Karp-Rabin hashes of ``match`` words, joined with the sorted
    ones of the block of tests that the task holds and confirmed word by word; runs of seeds are the matches
    that greedy tiling marks, longest first, so reordered passages count.
    Items with fewer words than ``match`` count where they are the whole text
    or a whole line, as they also stand in unrelated prose. Items with a null
    id are reported with it. The tests are read
    in blocks of ``block_bytes`` at most, each against all documents; what a
    task holds doesn't grow with the tests. Null or empty texts on either
    side match nothing; repeated rows are reported each; no tests or no
    documents give an empty result.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    given = tests.select(F.col(test_id).cast("long").alias("item_id"), F.col(test_text).alias("text")).where("text is not null")
    blocks = max(1, -(-(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    schema = "doc_id long, text_hash long, item_id long, coverage double, n_tiles long, n_matched long, n_item long, first_word long, last_word long"
    out = df.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # one bounded block
        if not rows:
            continue
        shared = df.sparkSession.sparkContext.broadcast(index_tests([r["item_id"] for r in rows], [r["text"] for r in rows], match))
        found = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_searcher(shared, match, coverage, passage), schema)
        out = found if block == 0 else out.union(found)
    return out


def _searcher(shared, match: int, coverage: float, passage: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = shared.value
        names = ["doc_id", "text_hash", "item_id", "coverage", "n_tiles", "n_matched", "n_item", "first_word", "last_word"]
        for batch in batches:
            out: list[tuple] = []
            for at, w in textkit.words(batch.column(1), textkit.ALNUM):
                grams = textkit.rolling_hashes(w.hashes, match)
                if not len(grams) or not len(tests.seeds):
                    continue
                spot = np.minimum(np.searchsorted(tests.seeds, grams), len(tests.seeds) - 1)
                hit = np.flatnonzero(tests.seeds[spot] == grams)
                doc = np.searchsorted(w.first, hit, "right") - 1
                inside = hit + match <= w.first[doc + 1]
                hit, doc = hit[inside], doc[inside]
                for d in np.unique(doc):
                    row = at + int(d)
                    for longest, *found in _of_document(tests, w.hashes, grams, hit[doc == d], int(w.first[d]), match):
                        if found[1] >= coverage or longest >= passage:
                            out.append((batch.column(0)[row].as_py(), batch.column(2)[row].as_py(), *found))
            for row, text in enumerate(batch.column(1).to_pylist() if tests.short else []):
                for found in _short_items(tests, text or "", match):
                    out.append((batch.column(0)[row].as_py(), batch.column(2)[row].as_py(), *found))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return search


def _of_document(tests: Tests, words: np.ndarray, grams: np.ndarray, hits: np.ndarray, first: int, match: int) -> Iterator[tuple]:
    lo, hi = (np.searchsorted(tests.seeds, grams[hits], side) for side in ("left", "right"))
    each = hi - lo
    places = np.repeat(hits - first, each)
    seed = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
    items, tests_at = tests.item[seed], tests.place[seed]
    for item in np.unique(items):
        mine = np.flatnonzero(items == item)
        n = len(tests.words[item])
        for i in range(match):  # equal hashes of a seed are confirmed word by word
            mine = mine[words[first + places[mine] + i] == tests.words[item][tests_at[mine] + i]]
        if not len(mine):
            continue
        tiles = tile(places[mine], tests_at[mine], n, match)
        covered = sum(t[2] for t in tiles)
        yield max(t[2] for t in tiles), tests.ids[item], covered / n, len(tiles), covered, n, min(t[0] for t in tiles), max(t[0] + t[2] for t in tiles) - 1


def without_contaminated(df: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All columns, of any names, of the documents that cover no test item enough."""
    key, hashed = internal(df, "key", "hash")
    found = materialize(contaminated(df, tests, doc_id, text, **how).select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).distinct(), "contaminated")
    return df.join(found, F.xxhash64(text).eqNullSafe(F.col(hashed)) & F.col(doc_id).cast("long").eqNullSafe(F.col(key)), "left_anti")
