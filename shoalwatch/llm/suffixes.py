"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts
elsewhere in the corpus. Such strings ("windows") first meet in buckets: a
window's bucket is the least hash of its q-grams, so equal windows share it.
Consecutive windows of one bucket travel together as a span. Spans that are
equal as a whole need no more work. Where different spans share a bucket,
their suffixes are sorted by bucket-pointer refinement: buckets of short
q-grams are refined by the bucket identifiers at later offsets, with each
refinement built on the identifiers that the one before has updated.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwatch.llm.common import Scratch, materialize
from shoalwatch.llm.textkit import U, _CODES, mix

#: Bytes of a string whose repetition counts, and of the q-grams of buckets.
LENGTH, GRAM = 200, 64
#: Text bytes of one block, unless a single document is longer.
BLOCK_BYTES = 1 << 20
#: Windows of one span at most; it must not exceed SEGMENT.
SPAN = 256
#: Window starts that are hashed at once.
SEGMENT = 1 << 20
#: Buckets of more different spans are refined over the cluster, not in one task.
HOT = 4096
#: Bytes that are sorted at once.
SORT_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = (_CODES, mix(_CODES) | U(1))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Sums:
    """Running polynomial sums of a byte array, for hashes of its parts."""

    def __init__(self, data: np.ndarray, which: int):
        base, n = _BASES[which], max(SEGMENT + 4096, len(data))
        self.inverse = _powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLES[which][data] * _powers(base, n)[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive numbers."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def spans(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Spans of a block of documents that end at ``ends``.

    ``key`` (bucket), ``h1, h2`` (of all bytes of the span), ``n`` (windows),
    ``place`` (first start) and ``again`` (a window may equal another of the
    same span). No window crosses a document's end.
    """
    out: dict[str, list] = {k: [] for k in ("key", "h1", "h2", "n", "place", "again")}
    width = length - gram + 1
    for lo in range(0, len(data), SEGMENT):
        part = data[lo : lo + SEGMENT + length - 1]
        windows = len(part) - length + 1
        if windows < 1:
            break
        first = _Sums(part, 0)
        h = first.hashes(slice(0, len(part) - gram + 1), slice(gram, len(part) + 1))
        v = _least(h, width)
        here = np.arange(lo, lo + windows)
        fits = ends[np.searchsorted(ends, here, "right")] - here >= length
        if not fits.any():
            continue
        edge = np.ones(windows, bool)
        edge[1:] = (v[1:] != v[:-1]) | (fits[1:] != fits[:-1])
        starts = np.flatnonzero(edge)
        sizes = np.diff(starts, append=windows)
        if (sizes > SPAN).any():
            pieces = -(-sizes // SPAN)
            number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ends_ = np.repeat(starts + sizes, pieces)
            starts = np.repeat(starts, pieces) + number * SPAN
            sizes = np.minimum(SPAN, ends_ - starts)
        kept = fits[starts]
        starts, sizes = starts[kept], sizes[kept]
        # a q-gram that is the least of a window at two near places: the text has a period
        least = h[:windows] == v
        also = np.zeros(len(h), bool)
        also[:windows] = least
        also[width - 1 :] |= h[width - 1 :] == v
        at = np.flatnonzero(also)
        twice = at[:-1][(h[at[:-1]] == h[at[1:]]) & (np.diff(at) < width)]
        last = starts + sizes - 1 + length
        out["key"].append(v[starts])
        out["h1"].append(first.hashes(starts, last))
        out["h2"].append(_Sums(part, 1).hashes(starts, last))
        out["n"].append(sizes)
        out["place"].append(starts + lo)
        out["again"].append(np.isin(v[starts], h[twice]))
    kinds = {"key": U, "h1": U, "h2": U, "n": np.int64, "place": np.int64, "again": bool}
    return {k: np.concatenate(x) if x else np.empty(0, kinds[k]) for k, x in out.items()}


def pointers(part: np.ndarray, which: int, length: int, gram: int) -> np.ndarray:
    """For each window of ``part`` its q-gram identifiers at later and later offsets, as one number.

    The identifiers are hashes, which all tasks agree on; the last q-gram
    ends with the window. So equal numbers in both ``which`` are equal windows.
    """
    n = len(part) - length + 1
    sums = _Sums(part, which)
    grams = sums.hashes(slice(0, len(part) - gram + 1), slice(gram, len(part) + 1))
    out = grams[:n]
    for offset in [*range(gram, length - gram, gram), length - gram]:
        out = mix(out * U(_BASES[1 - which]) + grams[offset : offset + n])
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows at ``starts`` equal another of them.

    Bucket-pointer refinement: buckets of 8-byte q-grams; a bucket's members
    are sorted by the bucket identifiers at the offset that the buckets are
    equal up to, which doubles the depth; identifiers of single members stay
    as they are. The last step overlaps to end at ``length`` (at least 16).
    """
    n = len(data)
    padded = np.zeros(n + 2 * length, np.uint8)
    padded[:n] = data
    grams = np.zeros(n + length, np.uint64)
    for i in range(8):
        grams = (grams << U(8)) | padded[i : i + n + length]
    bucket = np.unique(grams, return_inverse=True)[1].astype(np.int64)
    depth = 8
    while depth * 2 <= length:
        bucket = _refine(bucket, depth)
        depth *= 2
    here = bucket[starts] * (int(bucket.max()) + 1) + bucket[starts + length - depth]
    _, inverse, counts = np.unique(here, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _refine(bucket: np.ndarray, offset: int) -> np.ndarray:
    counts = np.bincount(bucket)
    members = np.flatnonzero(counts[bucket] > 1)
    later = np.minimum(members + offset, len(bucket) - 1)
    pointers = bucket[members] * (len(counts) + 1) + bucket[later]
    found, inverse = np.unique(pointers, return_inverse=True)
    out = np.empty(len(bucket), np.int64)
    single = np.ones(len(bucket), bool)
    single[members] = False
    out[members] = inverse
    out[single] = len(found) + np.arange(int(single.sum()))
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents into compressed blocks with a number that stays."""
    number = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=3)
    ids, texts, held = [], [], 0

    def block() -> pa.RecordBatch:
        data = press.compress(b"".join(texts))
        columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "data"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            raw = (text.as_py() or "").encode()
            if ids and held + len(raw) > BLOCK_BYTES:
                yield block()
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(doc_id.as_py())
            texts.append(raw)
            held += len(raw)
    if ids:
        yield block()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


_SPANS = "key long, h1 long, h2 long, n int, again boolean, block long, places array<int>"
_OPEN = "gone boolean, key long, block long, places array<int>, n int, need boolean"
_PARTS = "hot boolean, key long, h1 long, h2 long, n int, again boolean, block long, places array<int>, need boolean, bytes binary"
_GONE = "block long, places array<int>, n int"


def _fold(key, h1, h2, n, again, place, block: int) -> pa.RecordBatch:
    """One row for equal spans of a block, with all their places."""
    order = np.lexsort((place, n, h2, h1, key))
    key, h1, h2, n, again, place = (x[order] for x in (key, h1, h2, n, again, place))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (n[1:] != n[:-1])
    at = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)), pa.int32()), pa.array(place, pa.int32()))
    i64 = lambda x: pa.array(x[at].view(np.int64))
    columns = [i64(key), i64(h1), i64(h2), pa.array(n[at], pa.int32()), pa.array(again[at]), pa.array(np.full(len(at), block)), lists]
    return pa.RecordBatch.from_arrays(columns, names=["key", "h1", "h2", "n", "again", "block", "places"])


def _find_spans(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, data in zip(batch.column(0), batch.column(1), batch.column(2)):
                s = spans(_unpack(data.as_py()), np.cumsum(np.asarray(sizes.values)), length, gram)
                yield _fold(s["key"], s["h1"], s["h2"], s["n"], s["again"], s["place"], block.as_py())

    return find


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spans sorted by bucket and hash: which go, and which are open.

    A span goes if an equal one exists. One span of each hash is open if its
    bucket has others, or a period; ``need`` if it is not gone already. The
    task holds one batch and two rows, however large a bucket is.
    """
    names = ["gone", "key", "block", "places", "n", "need"]
    kept = ["key", "block", "places", "n"]
    held: pa.Table | None = None  # the last row seen, whose successor isn't known
    before: tuple | None = None  # class of the row before it
    start: tuple | None = None  # key of the last class, and its row if not yet open

    def told(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, before, start
        arrays = [np.asarray(t.column(c)) for c in ("key", "h1", "h2", "n")]
        rows = len(t) if last else len(t) - 1
        same = np.ones(len(t) - 1, bool)
        for a in arrays:
            same &= a[1:] == a[:-1]
        after = np.append(same, False)
        first = tuple(int(a[0]) for a in arrays)
        prior = np.append([before == first], same)
        places = np.diff(np.asarray(t.column("places").combine_chunks().offsets))
        gone = (prior | after | (places > 1))[:rows]
        begins = np.flatnonzero(~prior[:rows])
        key = arrays[0]
        is_open = np.zeros(len(begins), bool)
        need = ~gone[begins]
        pending = None
        for i, b in enumerate(begins.tolist()):
            k = int(key[b])
            if start is not None and start[0] == k:
                is_open[i] = True
                if start[1] is not None:
                    if isinstance(start[1], int):
                        is_open[start[1]] = True
                    else:
                        pending = start[1]
                start = (k, None)
            else:
                start = (k, i)
        is_open |= np.asarray(t.column("again"))[begins]
        if pending is not None:
            yield pending
        if start is not None and isinstance(start[1], int):
            i = start[1]
            row = None if is_open[i] else _rows(t, begins[i : i + 1], False, need[i : i + 1])
            start = (start[0], row)
        if gone.any():
            yield _rows(t, np.flatnonzero(gone), True, np.zeros(int(gone.sum()), bool))
        if is_open.any():
            yield _rows(t, begins[is_open], False, need[is_open])
        if not last:
            before = tuple(int(a[rows - 1]) for a in arrays) if rows else before
            held = t.slice(rows)

    def _rows(t: pa.Table, at: np.ndarray, gone: bool, need: np.ndarray) -> pa.RecordBatch:
        part = t.select(kept).take(pa.array(at)).combine_chunks().to_batches()[0]
        places = part.column(2)
        if not gone:
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), places.values.take(places.offsets[:-1]))
        return pa.RecordBatch.from_arrays([pa.array([gone] * len(at)), part.column(0), part.column(1), places, part.column(3), pa.array(need)], names=names)

    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            yield from told(t, False)
    if held is not None:
        yield from told(held.combine_chunks(), True)


def _cut(length: int, gram: int):
    """Bytes of open spans; for hot buckets each window by its q-gram identifiers."""
    names = ["hot", "key", "h1", "h2", "n", "again", "block", "places", "need", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, asked in zip(batch.column(0), batch.column(1), batch.column(2)):
                data, block = _unpack(packed.as_py()), block.as_py()
                asked = asked.values
                key, n, place, hot, need = (asked.field(c) for c in ("key", "n", "place", "hot", "need"))
                for i in np.flatnonzero(np.asarray(hot)).tolist():
                    at, size = place[i].as_py(), n[i].as_py()
                    part = data[at : at + size + length - 1]
                    h1, h2 = (pointers(part, w, length, gram) for w in (0, 1))
                    f = _fold(h1, h1, h2, np.ones(size, np.int64), np.zeros(size, bool), np.arange(at, at + size), block)
                    yield pa.RecordBatch.from_arrays([pa.array([True] * len(f)), *f.columns, pa.array([need[i].as_py()] * len(f)), pa.nulls(len(f), pa.binary())], names=names)
                cold = pa.array(~np.asarray(hot))
                key, n, place, need = (x.filter(cold) for x in (key, n, place, need))
                if len(key):
                    raw = data.tobytes()
                    parts = [raw[p : p + s + length - 1] for p, s in zip(place.to_pylist(), n.to_pylist())]
                    zero, lists = pa.array(np.zeros(len(key), np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1), pa.int32()), place)
                    yield pa.RecordBatch.from_arrays([pa.array([False] * len(key)), key, zero, zero, n, pa.array([False] * len(key)), pa.array([block] * len(key)), lists, need, pa.array(parts, pa.binary())], names=names)

    return cut


def _refined(length: int):
    """Sort the windows of open spans, whole buckets at a time."""

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        sizes = np.array([r[3] for r in rows])
        offset = np.concatenate(([0], np.cumsum(sizes + length - 1)[:-1]))
        own = np.repeat(np.arange(len(rows)), sizes)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        twice = repeated_windows(data, offset[own] + inner, length)
        twice &= np.array([r[5] for r in rows])[own]
        at = np.flatnonzero(twice)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (own[at[1:]] != own[at[:-1]])
        first = np.flatnonzero(new)
        run = np.diff(first, append=len(at))
        blocks = np.array([r[1] for r in rows], np.int64)[own[at[first]]]
        places = np.array([r[2] for r in rows], np.int64)[own[at[first]]] + inner[at[first]]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1), pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(blocks), lists, pa.array(run, pa.int32())], names=["block", "places", "n"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and held > SORT_BYTES and row[0] != rows[-1][0]:
                    yield sort(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield sort(rows)

    return refine


def _finish(length: int, keep_bytes: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, packed, gone in zip(*batch.columns):
                data = _unpack(packed.as_py())
                steps = np.zeros(len(data) + 1, np.int32)
                for part in gone.as_py() or []:
                    at = np.array(part["places"])
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + part["n"] + length - 1, -1)
                removed = np.cumsum(steps[:-1], dtype=np.int32, out=steps[:-1]) > 0
                del steps
                rows, lo = [], 0
                for doc_id, size in zip(ids.as_py(), sizes.as_py()):
                    mine, text = removed[lo : lo + size], data[lo : lo + size]
                    edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
                    left = text[~mine].tobytes() if len(edges) else text.tobytes()
                    rows.append((doc_id, size, size - len(left), len(edges) // 2, hashlib.sha256(left).hexdigest(), edges.reshape(-1, 2).tolist(), left if keep_bytes else None))
                    lo += size
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return finish


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept``.

    Texts are their UTF-8 bytes; null is empty. ``spans`` holds the start and
    end of each maximal removed run, ``kept`` the remaining bytes (null
    unless ``keep_bytes``). Every row is a document, so repeated rows match
    each other; a null doc_id is returned as null; texts shorter than
    ``length`` keep all bytes; an empty table gives an empty result. Buckets
    that hold more than ``HOT`` different spans are refined by a sort over
    the cluster, of their windows' q-gram identifiers at later offsets; these
    are 128-bit hashes, as exact as the hashes of equal spans. A task holds
    its largest text and some ten bytes for each byte of it.
    """
    if not 16 <= gram <= length:
        raise ValueError("gram must be from 16 to length")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = materialize(docs.mapInArrow(_pack, "block long, ids array<long>, sizes array<long>, data binary"), "blocks")
    scratch = Scratch()
    found = blocks.select("block", "sizes", "data").mapInArrow(_find_spans(length, gram), _SPANS)

    def sifted(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "h1", "h2", "n").mapInArrow(_sift, _OPEN)

    told = scratch(sifted(found), "sifted")
    opened = told.where("not gone").select("key", "block", F.col("places")[0].alias("place"), "n", "need")
    hot = opened.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT).select(F.col("key").alias("hot_key"))
    opened = opened.join(scratch(hot, "hot"), F.col("key") == F.col("hot_key"), "left").withColumn("hot", F.col("hot_key").isNotNull())
    asked = opened.groupBy("block").agg(F.collect_list(F.struct("key", "n", "place", "hot", "need")).alias("asked"))
    parts = scratch(blocks.select("block", "data").join(asked, "block").select("block", "data", "asked").mapInArrow(_cut(length, gram), _PARTS), "parts")
    cold = parts.where("not hot").select("key", "block", F.col("places")[0].alias("place"), "n", "bytes", "need")
    sorted_ = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_refined(length), _GONE)
    split = sifted(parts.where("hot").select("key", "h1", "h2", "n", "again", "block", "places"))
    gone = told.where("gone").select("block", "places", "n").union(sorted_).union(split.where("gone").select("block", "places", "n"))
    gone = materialize(gone, "gone")
    scratch.clear()
    per_block = gone.groupBy("block").agg(F.collect_list(F.struct("places", "n")).alias("gone"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary"
    return blocks.join(per_block, "block", "left").select("ids", "sizes", "data", "gone").mapInArrow(_finish(length, keep_bytes), schema)
