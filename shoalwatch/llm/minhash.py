"""Near-duplicate documents by MinHash with tensored banding.

The table keys of one document are all pairs of one half key of collection
A and one of collection B. With h half keys of w minhashes in each, 2 * w * h
minhashes serve h * h tables. Two documents of similarity s share a key
unless all half keys of a collection differ, which happens with a
probability of about 2 * (1 - s**w)**h; ``banding`` chooses w and h for a
similarity.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwatch.llm import textkit
from shoalwatch.llm.common import Scratch, append_columns, internal, materialize
from shoalwatch.llm.components import components

SHINGLE = 5
_HASHES = 32
#: A pair of the asked similarity shares no table with this probability at most.
TABLE_MISS = 1e-3
#: A pair in a table agrees on too few minhashes to be confirmed with this probability at most.
AGREE_MISS = 1e-6
#: Shingle frequencies that order a set are counted in this many buckets.
FREQUENCY_BUCKETS = 1 << 18
#: Groups of a rare shingle up to this size are compared pair by pair.
FEW = 6
#: A block of a larger group has about this many members and shingles at most.
CELL_MEMBERS, CELL_SHINGLES = 512, 1 << 19
COLUMNS = 4096

_MULTIPLY = textkit.mix(np.arange(101, 101 + _HASHES, dtype=np.uint64)) | np.uint64(1)
_ADD = textkit.mix(np.arange(501, 501 + _HASHES, dtype=np.uint64))


def with_signatures(df: DataFrame, text: str = "text", *, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Add ``n_shingles``, ``digest`` (of the shingle set) and ``minhashes``.

    Documents without words have 0 shingles and null for the others.
    """
    at = df.columns.index(text)

    def signed(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, digests, hashes = [], [], []
        for _, w in textkit.words(batch.column(at), textkit.SPACED):
            sets = list(textkit.shingle_sets(w, shingle))
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            lows = np.empty((len(full), _HASHES), "<u4")
            if len(full):
                every = np.concatenate(sets)
                offsets = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                for j in range(_HASHES):
                    lows[:, j] = np.minimum.reduceat(every * _MULTIPLY[j] + _ADD[j], offsets) >> np.uint64(32)
            row = iter(lows)
            sizes += n.tolist()
            digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            hashes += [next(row).tobytes() if len(s) else None for s in sets]
        return [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(hashes, pa.binary())]

    fields = [("n_shingles", T.LongType()), ("digest", T.BinaryType()), ("minhashes", T.BinaryType())]
    return append_columns(df, fields, signed, keep)


def banding(percent: int) -> tuple[int, int]:
    """Minhashes in a half key and half keys in a collection: as selective as ``TABLE_MISS`` allows."""
    for wide in (2, 1):
        half = _HASHES // 2 // wide
        if 2 * (1 - (percent / 100) ** wide) ** half <= TABLE_MISS:
            return wide, half
    raise ValueError(f"{_HASHES} minhashes find pairs of a similarity of {percent} % too seldom; ask for a higher one")


def least_agreement(percent: int) -> int:
    """Minhashes that a pair of the similarity shares but for a chance of ``AGREE_MISS``."""
    s, below, k = percent / 100, 0.0, 0
    while (below := below + math.comb(_HASHES, k) * s**k * (1 - s) ** (_HASHES - k)) <= AGREE_MISS:
        k += 1
    return k


def _table_keys(classes: DataFrame, percent: int) -> DataFrame:
    """``key, rep`` for every table."""
    wide, half = banding(percent)
    part = lambda i: F.substring("minhashes", 4 * wide * i + 1, 4 * wide)
    tables = classes.select("rep", F.struct(*[part(i).alias(f"p{i}") for i in range(2 * half)]).alias("p"))
    return tables.select("rep", F.explode(F.array(*[F.xxhash64(F.col(f"p.p{i}"), F.col(f"p.p{half + j}"), F.lit(i * half + j)) for i in range(half) for j in range(half)])).alias("key"))


def _agree(a: pa.Array, b: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(a.to_pylist()), "<u4").reshape(-1, _HASHES)
    y = np.frombuffer(b"".join(b.to_pylist()), "<u4").reshape(-1, _HASHES)
    return (x == y).sum(axis=1)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and minhashes don't rule a link out."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("minhashes").alias(f"m_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = joined.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)).select("a", "b", "m_a", "m_b")

    least = least_agreement(percent)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(_agree(batch.column(2), batch.column(3)) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return sized.mapInArrow(alike, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"t_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=64)
        def of(text: str) -> np.ndarray:
            _, w = next(textkit.words(pa.array([text], pa.string()), textkit.SPACED))
            return next(textkit.shingle_sets(w, shingle))

        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                x, y = of(ta.as_py()), of(tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return joined.mapInArrow(checked, "a long, b long").distinct()


def _labelled(buckets: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, component`` of the buckets that still hold several components."""
    told = buckets.join(labels, buckets["rep"] == labels["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    several = told.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    return told.join(scratch(several, "open-keys"), "key").select("rep", "component").distinct()


def _prefixes(members: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``shingle, rep, component, n, short``: the rarest shingles of each member.

    Two sets that reach the similarity share one of the first
    n - ceil(percent * n / 100) + 1 of their n shingles in any order common
    to all, and for the smaller set it is one of its first
    n - ceil(2 * percent * n / (100 + percent)) + 1, which ``short`` marks. The order here is by frequency among the members, counted in
    ``FREQUENCY_BUCKETS`` hashed buckets, so a passage that many share comes
    last. ``members`` has ``rep, component, text``.
    """
    mask = np.uint64(FREQUENCY_BUCKETS - 1)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCY_BUCKETS, np.int64)
        for batch in batches:
            for _, w in textkit.words(batch.column(0), textkit.SPACED):
                for s in textkit.shingle_sets(w, shingle):
                    np.add.at(total, (s & mask).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = members.select("text").mapInArrow(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(FREQUENCY_BUCKETS, np.int64)
    table[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    shared = members.sparkSession.sparkContext.broadcast(table)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w in textkit.words(batch.column(2), textkit.SPACED):
                reps, comps, n, short, out = [], [], [], [], []
                for i, s in enumerate(textkit.shingle_sets(w, shingle), at):
                    most = len(s) - -(-percent * len(s) // 100) + 1
                    order = np.lexsort((s, shared.value[(s & mask).astype(np.int64)]))[:most]
                    out.append(s[order].view(np.int64))
                    reps += [batch.column(0)[i].as_py()] * len(order)
                    comps += [batch.column(1)[i].as_py()] * len(order)
                    n += [len(s)] * len(order)
                    few = len(s) - -(-2 * percent * len(s) // (100 + percent)) + 1
                    short += [i < few for i in range(len(order))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(reps, pa.int64()), pa.array(comps, pa.int64()), pa.array(n, pa.int64()), pa.array(short, pa.bool_())], names=["shingle", "rep", "component", "n", "short"])

    return members.select("rep", "component", "text").mapInArrow(rarest, "shingle long, rep long, component long, n long, short boolean")


def _forest(rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """The links that join something new, of all links between row and column."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for a, b in zip(rows.tolist(), cols.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of indicator matrices."""
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every = every[order]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
    del order
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
    del every
    n = np.diff(np.append(first, len(owner)))
    # only shingles of several sets count; they get neighbouring columns
    owner = owner[np.repeat(n > 1, n)]
    n = n[n > 1]
    column = np.repeat(np.arange(len(n), dtype=np.int32), n)
    out = np.zeros((len(sets), len(sets)), np.int32)
    for lo in range(0, len(n), COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        out += np.rint(m @ m.T).astype(np.int32)
    return out


def _confirm_cells(rare: DataFrame, texts: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """Links within large groups of one shared rare shingle.

    A group is cut into blocks of bounded size, and each pair of blocks is a
    cell: all pairs are compared, but only a spanning forest of the links
    between different components comes out. Of groups with the same members
    one is compared.
    """
    members = rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("rep")).alias("x"))
    rare = rare.drop("m").join(scratch(members.groupBy("m", "s", "x").agg(F.min("shingle").alias("shingle")).select("shingle"), "distinct-groups"), "shingle")
    size = rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).select("shingle", F.greatest(F.ceil(F.col("m") / CELL_MEMBERS), F.ceil(F.col("total") / CELL_SHINGLES)).alias("blocks"))
    rare = rare.join(scratch(size, "blocks"), "shingle").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    cells = rare.select("shingle", "rep", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y")).select("shingle", F.least("own", "y").alias("i"), F.greatest("own", "y").alias("j"), "rep", "component")

    def compare(table: pa.Table) -> pa.Table:
        rep, comp = (np.array(table.column(c).to_pylist()) for c in ("rep", "component"))
        sets = []
        for _, w in textkit.words(table.column("text").combine_chunks(), textkit.SPACED):
            sets += list(textkit.shingle_sets(w, shingle))
        n = np.array([len(s) for s in sets], np.int64)
        both = _common(sets)
        del sets
        linked = (100 + percent) * both.astype(np.int64) >= percent * (n[:, None] + n[None, :])
        rows, cols = np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :]), 1))
        kept = _forest(rows, cols)
        return pa.table({"a": pa.array([int(rep[x]) for x, _ in kept], pa.int64()), "b": pa.array([int(rep[y]) for _, y in kept], pa.int64())})

    return cells.join(texts, "rep").groupBy("shingle", "i", "j").applyInArrow(compare, "a long, b long")


def _across(left: DataFrame, texts: DataFrame, classes: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """Links between the components of ``left`` (``rep, component``).

    Every pair that shares one of its rarest shingles is compared: pairs of
    small groups one by one, those of larger groups in cells.
    """
    members = scratch(left.join(texts, "rep"), "left-texts")
    rare = scratch(_prefixes(members, percent, shingle), "prefixes")
    least = rare.groupBy("shingle").agg(F.min(F.when(F.col("short"), F.col("n"))).alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi and least is not null").select("shingle", "least")
    rare = scratch(rare.join(scratch(least, "least"), "shingle").where("short or n >= least").drop("least"), "useful-prefixes")
    groups = rare.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi").select("shingle", "m")
    rare = scratch(rare.join(scratch(groups, "groups"), "shingle"), "shared-prefixes")
    few = rare.where(F.col("m") <= FEW)
    side = lambda x: few.select("shingle", F.col("rep").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("short").alias(f"s{x}"))
    pairs = side("a").join(side("b"), "shingle").where("ca < cb and (sa and na <= nb or sb and nb <= na)").select("a", "b").distinct()
    own = members.select("rep", "text")
    return _confirm(_plausible(pairs, classes, percent), own, percent, shingle).union(_confirm_cells(rare.where(F.col("m") > FEW), own, percent, shingle, scratch))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """Group documents linked by a Jaccard similarity of ``percent`` or more.

    Returns per row ``doc_id, n_shingles, component_id, kept``. Texts are
    lower-cased (A-Z) and cut into words at ASCII white space; a document's
    set holds its distinct ``shingle``-word shingles, or its whole sequence
    if it has fewer words. Documents without words or text have an empty set
    and link with nothing. Rows with one doc_id are one document: they share
    a component. A null doc_id has a null component and is not kept. Equal
    sets make one class, whose smallest doc_id stands for it; an empty table
    gives an empty result.

    Within each bucket the members are first compared with the bucket's
    smallest, so a group of copies costs a comparison each and not all
    pairs. Then the members of buckets that still hold several components
    are compared across components: all pairs that share one of their
    rarest shingles, which a link implies. So no link in a bucket is lost,
    and a passage that many documents share does not pair them all.
    """
    scratch = Scratch()
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(with_signatures(docs, keep=["doc_id"], shingle=shingle), "signatures")
    some = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("minhashes").alias("minhashes")), "classes")

    keys = _table_keys(classes, percent)
    shared = scratch(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub")).where("n > 1").drop("n"), "shared-keys")
    buckets = scratch(keys.join(shared, "key").select("key", "rep", "hub"), "buckets")
    members = scratch(buckets.select("rep").distinct(), "members")
    texts = scratch(docs.join(members, docs["doc_id"] == members["rep"]).select("rep", "text").distinct(), "texts")

    pairs = buckets.where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    links = _plausible(pairs, classes, percent)
    edges = scratch(_confirm(links, texts, percent, shingle), "links")
    left = scratch(_labelled(buckets, scratch(components(edges), "labels"), scratch), "left")
    edges = edges.union(scratch(_across(left, texts, classes, percent, shingle, scratch), "links"))
    labels = components(edges.union(_same_document(some)))
    scratch.clear()
    reps = classes.select("digest", "rep")
    told = signed.join(reps, "digest", "left").withColumn("at", F.coalesce("rep", "doc_id")).join(labels, F.col("at") == labels["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return told.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _same_document(signed: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    per_doc = signed.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("doc_id")
    rep = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    own = signed.join(per_doc, "doc_id").join(rep, "digest").where(F.col("rep") != F.col("doc_id"))
    return own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def without_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """All columns of one document of each group: that of the smallest doc_id.

    Of rows that share a doc_id one stays, that of the smallest hash of the
    text, and the first read of equal ones; rows with a null doc_id all
    stay. Columns of any name pass through. The ids are joined by shuffle at
    every size, as they grow with the corpus.
    """
    found = near_duplicates(df, doc_id, text, percent=percent, shingle=shingle)
    key, hashed, number, one = internal(df, "key", "hash", "number", "one")
    kept = materialize(found.where("kept").select(F.col("doc_id").alias(key)).distinct(), "kept")
    mine = df.where(F.col(doc_id).cast("long").isNotNull()).withColumns({key: F.col(doc_id).cast("long"), hashed: F.xxhash64(text), number: F.monotonically_increasing_id()})
    mine = mine.withColumn(one, F.row_number().over(Window.partitionBy(key).orderBy(hashed, number))).where(F.col(one) == 1)
    mine = mine.join(kept.hint("merge"), key, "left_semi").select(*df.columns)
    return mine.unionByName(df.where(F.col(doc_id).cast("long").isNull()))
