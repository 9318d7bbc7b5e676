"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are brought to one length by a further component, so that the
largest inner product is the nearest on the sphere, and padded to a power of
two. Three rounds of random signs and a Hadamard transform turn them; a
table's bucket is the signed axis that is nearest then, in large collections
together with that of a second, narrower turn. A query looks at the buckets
whose axes it is nearest to, in as many tables as there are; how many of
them is measured against brute force on a sample of queries, so that the
wished recall is reached. All that a bucket holds is ranked by exact inner
products in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwatch.llm.common import Scratch, materialize

TABLES = 4
#: Recall on the sample of queries from which the number of probes follows.
RECALL = 0.96
#: Queries of the sample at most, and numbers they hold.
SAMPLE, SAMPLE_NUMBERS = 256, 1 << 20
#: Axes of the second turn's signs; it is used from so many vectors a bucket on.
NARROW, FULL = 16, 1024
#: Buckets of the first table that give each query a bound for the other ones.
FIRST = 4
#: Vectors of one cell, and queries; fewer if they are long.
CELL_ROWS, CELL_QUERIES, CELL_NUMBERS = 4096, 4096, 1 << 19
_SEED, _NEAR = 11, 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows of a power of two, keeping lengths."""
    rows, n = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(rows, n // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, n)
        half *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class Tables:
    dim: int
    #: the largest length among all vectors
    length: float
    tables: int = TABLES
    #: whether buckets have a second, narrower part
    deep: bool = False
    #: buckets of each table that a query looks at
    probes: int = 1

    @property
    def width(self) -> int:
        # twice the room for the vectors, for finer buckets
        return 1 << self.dim.bit_length() if self.dim & (self.dim - 1) else max(2, 2 * self.dim)

    @property
    def narrow(self) -> int:
        return min(NARROW, self.width)

    @property
    def buckets(self) -> int:
        return 2 * self.width * (2 * self.narrow if self.deep else 1)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors in the padded space."""
        out = np.zeros((len(x), self.width))
        out[:, : self.dim] = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.length)
        if not query:
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (out**2).sum(1)))
        return out

    def _turned(self, y: np.ndarray, table: int, part: int) -> np.ndarray:
        rng = np.random.default_rng((_SEED, self.dim, table, part))
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], self.width))
        return y[:, : self.narrow] if part else y

    def assign(self, lifted: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row."""
        out = np.zeros(len(lifted), np.int64)
        for part in range(1 + self.deep):
            y = self._turned(lifted, table, part)
            axis = np.abs(y).argmax(1)
            out = out * 2 * y.shape[1] + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def nearness(self, lifted: np.ndarray, table: int) -> np.ndarray:
        """Rows by buckets: products with the buckets' axes, summed over both parts."""
        out = None
        for part in range(1 + self.deep):
            y = self._turned(lifted, table, part)
            signed = np.stack((y, -y), axis=2).reshape(len(y), -1)
            out = signed if out is None else (out[:, :, None] + signed[:, None, :]).reshape(len(y), -1)
        return out

    def probed(self, lifted: np.ndarray, table: int) -> np.ndarray:
        """The buckets each row looks at; of equally near ones those of smaller numbers."""
        return np.argsort(-self.nearness(lifted, table), axis=1, kind="stable")[:, : self.probes]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _best(query: np.ndarray, score: np.ndarray, id: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((id, -score, query))
    own = query[order]
    if not len(own):
        return order
    begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return order[np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own)))) < k]


def _ranked(q: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query place, score, row place`` of the ``k`` rows nearest to each query.

    Fast products choose all that can be among them, exact ones rank.
    """
    if not (len(q) and len(x)):
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    fast = q @ x.T
    if len(x) > k:
        slack = _NEAR * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        i, j = np.nonzero(fast >= (np.partition(fast, len(x) - k, axis=1)[:, len(x) - k] - slack)[:, None])
    else:
        i, j = (m.ravel() for m in np.indices(fast.shape))
    score = np.concatenate([exact_products(q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
    best = _best(i, score, x_id[j], k)
    return i[best], score[best], j[best]


def _probe_ranks(tables: Tables, queries: np.ndarray, ids: np.ndarray, k: int):
    """Candidates for the nearest of each sampled query, with the probes that would find them."""

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lifted = tables.lifted(queries, True)
        near = [tables.nearness(lifted, t) for t in range(tables.tables)]
        for batch in batches:
            for lo in range(0, batch.num_rows, CELL_ROWS):
                part = batch.slice(lo, CELL_ROWS)
                x_id, x = np.asarray(part.column(0)), _matrix(part.column(1))
                i, score, j = _ranked(queries, x, x_id, k + 1)
                other = ids[i] != x_id[j]
                i, score, j = i[other], score[other], j[other]
                rank = np.full(len(i), tables.buckets)
                places = np.unique(j)
                rows = tables.lifted(x[places], False)
                for t in range(tables.tables):
                    bucket = tables.assign(rows, t)[np.searchsorted(places, j)]
                    for s in range(0, len(i), 1024):
                        own, at = near[t][i[s : s + 1024]], bucket[s : s + 1024]
                        mine = own[np.arange(len(at)), at][:, None]
                        before = (own > mine).sum(1) + ((own == mine) & (np.arange(own.shape[1])[None, :] < at[:, None])).sum(1)
                        rank[s : s + 1024] = np.minimum(rank[s : s + 1024], before)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(score), pa.array(x_id[j], pa.int64()), pa.array(rank, pa.int64())], names=["query", "score", "id", "rank"])

    return ranks


def fit(classes: DataFrame, asked: DataFrame, dim: int, length: float, n: int, *, k: int, recall: float, deep: bool | None = None, sample: int = SAMPLE) -> Tables:
    """Tables for ``classes`` (``rep, vector``) whose probes reach ``recall`` on a sample of ``asked``.

    The sample is compared with every row; its true neighbours tell after how
    many probes they would have been found.
    """
    tables = Tables(dim, length)
    tables = replace(tables, deep=n >= FULL * tables.buckets if deep is None else deep)
    rows = asked.orderBy(F.xxhash64(F.lit(_SEED), "rep")).limit(max(16, min(sample, SAMPLE_NUMBERS // dim))).toArrow()
    if not rows.num_rows:
        return tables
    queries, ids = _matrix(rows.column("vector")), np.asarray(rows.column("rep"))
    found = classes.select("rep", "vector").mapInArrow(_probe_ranks(tables, queries, ids, k), "query long, score double, id long, rank long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    truth = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("rank").toArrow()
    ranks = np.sort(np.asarray(truth.column(0).combine_chunks())) if truth.num_rows else np.zeros(1, np.int64)
    return replace(tables, probes=int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1)


def _place(tables: Tables):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lifted = tables.lifted(_matrix(part.column(1)), False)
                buckets = np.stack([tables.assign(lifted, t) for t in range(tables.tables)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(buckets.tolist(), pa.list_(pa.int64()))], names=["rep", "vector", "buckets"])

    return place


def _ask(tables: Tables, groups: int):
    """For each query the cells it looks into, with the buckets there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                lifted = tables.lifted(_matrix(part.column(1)), True)
                cells: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for t in range(tables.tables):
                    for own, buckets in zip(cells, tables.probed(lifted, t)):
                        group = buckets % groups
                        own += [{"cell": t * groups + int(g), "wanted": buckets[group == g].tolist()} for g in np.unique(group)]
                kind = pa.list_(pa.struct([("cell", pa.int64()), ("wanted", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, kind)], names=["rep", "vector", "least", "cells"])

    return ask


_FOUND = "query long, score double, id long"


def _search(k: int):
    """Rank a cell's rows for its queries, bucket by bucket; below ``least`` nothing is of use."""

    def search(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("asks"))
        asks, rows = (table.filter(pa.array(m)) for m in (role, ~role))
        q, x = (_matrix(t.column("vector")) for t in (asks, rows))
        q_id, x_id = (np.asarray(t.column("rep")) for t in (asks, rows))
        bucket, least = np.asarray(rows.column("bucket")), np.asarray(asks.column("least"))
        wanted = asks.column("wanted").combine_chunks()
        own = np.repeat(np.arange(len(q)), np.diff(np.asarray(wanted.offsets))) if len(q) else np.empty(0, np.int64)
        flat = np.asarray(wanted.flatten())
        out = [[np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]]
        for b in np.intersect1d(bucket, flat):
            who, which = own[flat == b], np.flatnonzero(bucket == b)
            i, score, j = _ranked(q[who], x[which], x_id[which], k)
            use = score >= least[who[i]]
            i, score, j = i[use], score[use], j[use]
            for column, values in zip(out, (who[i], score, x_id[which[j]])):
                column.append(values)
        i, score, id = (np.concatenate(c) for c in out)
        best = _best(i, score, id, k)
        return pa.table({"query": pa.array(q_id[i[best]] if len(q) else i, pa.int64()), "score": pa.array(score[best]), "id": pa.array(id[best], pa.int64())})

    return search


def _candidates(tables: Tables, classes: DataFrame, asked: DataFrame, n: int, k: int, scratch: Scratch) -> DataFrame:
    """``query, score, id`` of the best ``k`` that each cell has for each query of ``asked`` (``rep, vector, least``)."""
    rows_at_most = max(16, min(CELL_ROWS, CELL_NUMBERS // tables.dim))
    groups = min(tables.buckets, -(-n // rows_at_most))
    kind = dict(classes.dtypes)["vector"]
    placed = scratch(classes.select("rep", "vector").mapInArrow(_place(tables), f"rep long, vector {kind}, buckets array<long>"), "placed")
    asking = scratch(asked.mapInArrow(_ask(tables, groups), f"rep long, vector {kind}, least double, cells array<struct<cell:long,wanted:array<long>>>"), "asking")
    held = placed.select("rep", "vector", F.posexplode("buckets").alias("t", "bucket")).withColumn("cell", F.col("t") * groups + F.col("bucket") % groups)
    ask = asking.select("rep", "vector", "least", F.explode("cells").alias("c")).select("rep", "vector", "least", "c.*")
    blocks = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = scratch(blocks(held.select("cell"), rows_at_most, "nx").join(blocks(ask.select("cell"), min(rows_at_most, CELL_QUERIES), "nq"), "cell"), "sizes")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    columns = ["cell", "i", "j", "asks", "rep", "vector", "bucket", "wanted", "least"]
    held = held.join(sizes, "cell").withColumn("i", own("nx")).withColumn("j", every("nq")).withColumns({"asks": F.lit(False), "wanted": F.lit(None).cast("array<long>"), "least": F.lit(None).cast("double")}).select(columns)
    ask = ask.join(sizes, "cell").withColumn("j", own("nq")).withColumn("i", every("nx")).withColumns({"asks": F.lit(True), "bucket": F.lit(None).cast("long")}).select(columns)
    return held.union(ask).groupBy("cell", "i", "j").applyInArrow(_search(k), _FOUND)


def _all(classes: DataFrame, asked: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """As ``_candidates``, from all rows: for queries whose buckets hold too few."""
    most = max(16, min(CELL_ROWS, CELL_NUMBERS // dim))
    nx, nq = -(-n // most), max(1, -(-asked.count() // most))
    own = lambda m: F.pmod(F.xxhash64("rep"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    columns = ["i", "j", "asks", "rep", "vector", "bucket", "wanted", "least"]
    held = classes.select("rep", "vector").withColumn("i", own(nx)).withColumn("j", every(nq)).withColumns({"asks": F.lit(False), "bucket": F.lit(0).cast("long"), "wanted": F.lit(None).cast("array<long>"), "least": F.lit(None).cast("double")}).select(columns)
    ask = asked.withColumn("j", own(nq)).withColumn("i", every(nx)).withColumns({"asks": F.lit(True), "bucket": F.lit(None).cast("long"), "wanted": F.array(F.lit(0).cast("long"))}).select(columns)
    return held.union(ask).groupBy("i", "j").applyInArrow(_search(k), _FOUND)


def usable_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, vector``: rows that take part.

    Left out are null ids, null, empty and zero vectors and those with null
    or non-finite components. ``vec_id`` names a row: of rows that share
    one, that of the smallest vector counts, and repeated rows count once.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound & F.exists("vector", lambda v: v != 0), F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(vectors: DataFrame, asks: Column, *, k: int = 20, recall: float = RECALL, deep: bool | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest other rows of the rows that ``asks`` holds for.

    ``vectors`` are ``vec_id, vector`` (``usable_vectors``). Nearest is the
    largest inner product, in double precision from the first component to
    the last; ties go to smaller ids. Vectors of other dimensions are no
    candidates. A query gets ``k`` rows, or all if there are fewer; one whose
    buckets hold too few is compared with all rows. Without queries or
    candidates there is nothing in the result.

    Equal vectors are one class, of which no query needs more than its
    ``k + 1`` smallest ids; so copies cost one row of the tables each way.
    """
    scratch = Scratch()
    rows = vectors.withColumns({"x": F.xxhash64("vector"), "y": F.xxhash64(F.lit(1), "vector"), "dim": F.size("vector"), "asks": F.coalesce(asks, F.lit(False))})
    rows = scratch(rows, "rows")
    class_of = ["dim", "x", "y"]
    order = Window.partitionBy(*class_of).orderBy("vec_id")
    members = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    first = F.max(F.when(F.col("place") == 1, F.col("vector")))
    classes = scratch(members.groupBy(*class_of).agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"), first.alias("vector")), "classes")
    queries = scratch(rows.where("asks").select("vec_id", *class_of).join(classes.select(*class_of, "rep"), class_of).select("vec_id", "rep", "dim"), "queries")
    asked = queries.select("rep").distinct()
    double = F.transform("vector", lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, v: s + v * v))
    found = None
    for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("length")).orderBy("dim").collect():
        own = classes.where(F.col("dim") == r["dim"]).select("rep", "ids", "vector")
        mine = _nearest_classes(own, asked, r["dim"], r["length"], r["n"], k, recall, deep, scratch)
        found = mine if found is None else found.union(mine)
    if found is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    told = queries.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(found, "query").where("query_id != vec_id")
    out = materialize(told.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    scratch.clear()
    return out


def _nearest_classes(classes: DataFrame, asked: DataFrame, dim: int, length: float, n: int, k: int, recall: float, deep: bool | None, scratch: Scratch) -> DataFrame:
    """``query, vec_id, score``: the ``k + 1`` nearest ids of each asked class."""
    asked = scratch(asked.join(classes.select("rep", "vector"), "rep"), "asked")
    tables = fit(classes, asked, dim, length, n, k=k, recall=recall, deep=deep)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def best(cells: DataFrame) -> DataFrame:
        # a class that several tables find has one score
        return cells.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")

    # a few buckets of one table tell what the others have to reach, so that their cells return little
    first = replace(tables, tables=1, probes=min(tables.probes, FIRST))
    asked = asked.select("rep", "vector", F.lit(float("-inf")).alias("least"))
    early = best(_candidates(first, classes, asked, n, k + 1, scratch)).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("reached"))
    early = early.where(F.col("n") == k + 1).select(F.col("query").alias("rep"), "reached")
    asked = scratch(asked.join(early, "rep", "left").select("rep", "vector", F.coalesce("reached", "least").alias("least")), "bounded")
    found = scratch(best(_candidates(tables, classes, asked, n, k + 1, scratch)), "found")
    ids = classes.select(F.col("rep").alias("id"), "ids")
    expanded = found.join(ids, "id").select("query", "score", F.explode("ids").alias("vec_id"))
    enough = expanded.groupBy("query").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") > k)
    lacking = scratch(asked.join(enough.select(F.col("query").alias("rep")), "rep", "left_anti"), "lacking")
    if not lacking.isEmpty():
        more = scratch(best(_all(classes, lacking, dim, n, k + 1)), "more").join(ids, "id").select("query", "score", F.explode("ids").alias("vec_id"))
        expanded = expanded.join(lacking.select(F.col("rep").alias("query")), "query", "left_anti").select(more.columns).union(more)
    nearest_ids = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return expanded.withColumn("place", nearest_ids).where(F.col("place") <= k + 1).select("query", "vec_id", "score")
