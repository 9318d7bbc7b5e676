"""Hard negatives by exact search in a rotated space.

All vectors are turned by an orthogonal matrix that gathers their length in
the leading components. A score is then the sum of the leading components'
products so far and a remainder, which the norms of both remainders bound.
What the bounds rule out is dropped early; the rest is scored in integers.
Bounds allow for rounding, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalwatch.llm.common import Scratch, materialize

#: The rotation is fitted on vectors of so many numbers in all.
SAMPLE_NUMBERS = 1 << 20
#: Numbers that the rows of a cell hold at most, and scores of rows by anchors.
CELL_NUMBERS, CELL_SCORES = 1 << 18, 1 << 20
#: Shares of the components after which bounds are looked at.
STEPS = (0.25, 0.5, 0.75)
#: Part of all pairs beyond which the next products are made for all of them.
DENSE = 0.125
_SLACK = 1e-9
_SEED = 7


@dataclass(frozen=True)
class Rotation:
    """Columns are the principal directions, the strongest first."""

    matrix: np.ndarray

    @property
    def steps(self) -> list[int]:
        d = len(self.matrix)
        return sorted({max(1, int(d * s)) for s in STEPS})


def fit_rotation(vectors: np.ndarray) -> Rotation:
    """From the second moments, as products and not distances are asked for."""
    scaled = vectors / max(1.0, float(np.abs(vectors).max()))
    _, directions = np.linalg.eigh(scaled.T @ scaled)
    return Rotation(np.ascontiguousarray(directions[:, ::-1]))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of integers as bytes, each in the smallest of three widths."""
    most = np.abs(x).max(axis=1, initial=0)
    kinds = [np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]
    of = np.searchsorted([2**15, 2**31], most, "right")
    return pa.array([row.astype(kinds[k]).tobytes() for row, k in zip(x, of)], pa.binary())


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), dim), np.int64)
    for i, row in enumerate(rows):
        out[i] = np.frombuffer(row, f"<i{len(row) // dim}")
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            x = np.asarray(part.column(2).flatten()).reshape(part.num_rows, -1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _packed(x)], names=["vec_id", "label", "vector"])


def _best_of(anchor: np.ndarray, score: np.ndarray, id: np.ndarray, k: int) -> np.ndarray:
    """Places of each anchor's ``k`` first rows: higher scores, then smaller ids."""
    order = np.lexsort((id, -score, anchor))
    own = anchor[order]
    begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    rank = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
    return order[rank < k]


class Search:
    """The best rows of one cell for all windows of all its anchors."""

    def __init__(self, rotation: Rotation, a: np.ndarray, x: np.ndarray, scores: int = CELL_SCORES):
        self.rotation, self.a, self.x, self.scores = rotation, a, x, scores
        #: pairs scored in integers
        self.scored = 0
        self.ya, self.yx = (v.astype(np.float64) @ rotation.matrix for v in (a, x))
        steps = [0, *rotation.steps, len(rotation.matrix)]
        self.parts = list(zip(steps[:-1], steps[1:]))
        # norms of what is left after each part, for anchors and rows
        self.rest = [[np.sqrt((y[:, hi:] ** 2).sum(1)) for _, hi in self.parts] for y in (self.ya, self.yx)]
        self.slack = [_SLACK * np.sqrt((y**2).sum(1)) for y in (self.ya, self.yx)]
        self.size = [np.sqrt((y**2).sum(1)) for y in (self.ya, self.yx)]

    def run(self, ids: np.ndarray, allowed, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``window, anchor, score, id`` of the first ``k`` rows of each window.

        ``low`` and ``high`` (windows x anchors, inclusive) bound the scores;
        ``allowed`` tells for rows from one place to another which of them
        an anchor may get.
        """
        n = max(1, self.scores // max(1, len(self.a)))
        least = low.copy()  # rises with what is found
        kept = [[np.empty(0, np.int64)] * 3 for _ in low]
        hi, step = 0, min(n, 256)  # few rows first, as what they give drops many others
        while hi < len(self.x):
            lo, hi, step = hi, min(hi + step, len(self.x)), min(n, 2 * step)
            i, j = self._survivors(allowed(lo, hi), lo, hi, least, high)
            self.scored += len(i)
            score = np.concatenate([np.einsum("ij,ij->i", self.a[i[s : s + 65536]], self.x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.empty(0, np.int64)])
            for w in range(len(low)):
                fits = (score >= low[w][i]) & (score <= high[w][i])
                found = [np.concatenate((old, new[fits])) for old, new in zip(kept[w], (i, score, ids[j]))]
                if len(found[0]):
                    best = _best_of(*found, k)
                    kept[w] = [f[best] for f in found]
                    full = np.bincount(kept[w][0], minlength=len(self.a)) == k
                    last = np.full(len(self.a), np.iinfo(np.int64).max)
                    np.minimum.at(last, kept[w][0], kept[w][1])
                    least[w][full] = last[full]
        out = [[np.full(len(kept[w][0]), w), *kept[w]] for w in range(len(low))]
        return tuple(np.concatenate(c) for c in zip(*out))

    def _survivors(self, alive: np.ndarray, lo: int, hi: int, least: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and rows whose scores can fall into a window."""
        partial = np.zeros(alive.shape)
        dense, i, j = True, None, None
        for t, (a, b) in enumerate(self.parts):
            if dense:
                partial += self.ya[:, a:b] @ self.yx[lo:hi, a:b].T
                left = np.outer(self.rest[0][t], self.rest[1][t][lo:hi]) + np.outer(self.slack[0], self.size[1][lo:hi])
                fits = np.zeros(alive.shape, bool)
                for below, above in zip(least, high):
                    fits |= (partial + left >= below[:, None]) & (partial - left <= above[:, None])
                alive = alive & fits
                if alive.sum() <= DENSE * alive.size:
                    dense = False
                    i, j = np.nonzero(alive)
                    partial = partial[i, j]
            else:
                for s in range(0, len(i), 65536):
                    partial[s : s + 65536] += np.einsum("ij,ij->i", self.ya[i[s : s + 65536], a:b], self.yx[j[s : s + 65536] + lo, a:b])
                left = self.rest[0][t][i] * self.rest[1][t][j + lo] + self.slack[0][i] * self.size[1][j + lo]
                fits = np.zeros(len(i), bool)
                for below, above in zip(least, high):
                    fits |= (partial + left >= below[i]) & (partial - left <= above[i])
                i, j, partial = i[fits], j[fits], partial[fits]
        if dense:
            i, j = np.nonzero(alive)
        return i, j + lo


def _cell(rotation: Rotation, dim: int, same: bool, k: int, scores: int):
    """Search one cell: rows of ``asks`` are its anchors, with their windows.

    ``same`` asks for rows of the anchor's label, else for the others'.
    """

    def search(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("asks"))
        anchors, rows = (table.filter(pa.array(m)) for m in (role, ~role))
        names = ["anchor_id", "window", "score", "id"]
        if not (anchors.num_rows and rows.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        a_id, x_id = (np.asarray(t.column("vec_id")) for t in (anchors, rows))
        a_label, x_label = (np.asarray(t.column("label")) for t in (anchors, rows))
        windows = anchors.column("windows").to_pylist()
        n = max(map(len, windows))
        ends = np.iinfo(np.int64)
        low, high = np.full((n, len(a_id)), ends.max), np.full((n, len(a_id)), ends.min)  # holds nothing
        for i, own in enumerate(windows):
            for w, window in enumerate(own):
                low[w, i], high[w, i] = window["low"], window["high"]

        def allowed(lo: int, hi: int) -> np.ndarray:
            alike = a_label[:, None] == x_label[None, lo:hi]
            return (alike & (a_id[:, None] != x_id[None, lo:hi])) if same else ~alike

        a, x = (_unpacked(t.column("vector").combine_chunks(), dim) for t in (anchors, rows))
        window, anchor, score, id = Search(rotation, a, x, scores).run(x_id, allowed, low, high, k)
        return pa.table(dict(zip(names, (a_id[anchor], window, score, id))))

    return search


_FOUND = "anchor_id long, window long, score long, id long"
_ANY = "array(named_struct('low', -9223372036854775807L, 'high', 9223372036854775807L))"


def _cells(rows: DataFrame, anchors: DataFrame, by: list[str], dim: int, scratch: Scratch) -> DataFrame:
    """Rows and anchors (with ``windows``) dealt to cells of bounded size, by ``by`` and blocks."""
    block = max(16, CELL_NUMBERS // dim)
    if by:
        blocks = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
        sizes = scratch(blocks(rows, "nx").join(blocks(anchors, "nq"), by), "sizes")  # a label without anchors has no cell
        with_sizes = lambda df: df.join(sizes, by)
    else:
        nx, nq = (max(1, -(-df.count() // block)) for df in (rows, anchors))
        with_sizes = lambda df: df.withColumns({"nx": F.lit(nx), "nq": F.lit(nq)})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    columns = ["i", "j", "asks", "vec_id", "label", "vector", "windows"]
    nothing = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    held = with_sizes(rows).withColumn("i", own("nx")).withColumn("j", every("nq")).withColumns({"asks": F.lit(False), "windows": nothing}).select(columns)
    asking = with_sizes(anchors).withColumn("j", own("nq")).withColumn("i", every("nx")).withColumn("asks", F.lit(True)).select(columns)
    return held.union(asking).groupBy(*by, "i", "j")


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The ``k`` best of all cells, numbered in ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integer_rows(df: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", *, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector``: components as floor(scale * x), rows that can't take part left out.

    Left out are nulls of any column, empty vectors, and null or non-finite
    components; further, vectors whose integers are so long that a score
    might not fit 64 bits (a square of 2**55 or more).
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where("vec_id is not null and label is not null and size(e) > 0").where(F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("e", F.transform("e", lambda v: F.floor(v * scale).cast("double")))  # whole numbers; a huge one is left out below
    square = F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v)
    return rows.where(square < 2.0**55).select("vec_id", "label", F.transform("e", lambda v: v.cast("long")).alias("vector"))


def hard_negatives(rows: DataFrame, every: int, *, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scores: int = CELL_SCORES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` are ``vec_id, label, vector`` of integers (``integer_rows``).
    Anchors are the rows whose id ``every`` divides; an anchor's positives
    are its first rows of its own label, by integer inner product and then
    by smaller id, its hard negatives the first rows of another label whose
    scores are from ``least`` to ``most`` percent of the positive's. A
    positive of a score below 0 has none, as that range is empty.

    ``vec_id`` names a row: of rows that share one, the smallest label and
    vector count, and repeated rows count once. Vectors of different
    dimensions aren't compared. Without rows, anchors, positives or
    negatives there is nothing in the result.
    """
    scratch = Scratch()
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")
    held = scratch(one.withColumn("dim", F.size("vector")), "vectors")
    found = None
    for dim in [r["dim"] for r in held.select("dim").distinct().orderBy("dim").collect()]:
        own = _of_dimension(held.where(F.col("dim") == dim).drop("dim"), dim, every, positives, negatives, least, most, scores, scratch)
        found = own if found is None else found.union(own)
    if found is None:
        return rows.select(*[F.lit(0).cast("long").alias(c) for c in ("anchor_id", "positive_id")], F.lit(0).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in ("negative_id", "positive_score", "negative_score")]).where("false")
    out = materialize(found, "negatives")
    scratch.clear()
    return out


def _of_dimension(held: DataFrame, dim: int, every: int, positives: int, negatives: int, least: int, most: int, scores: int, scratch: Scratch) -> DataFrame:
    sample = held.select("vector").orderBy(F.xxhash64(F.lit(_SEED), "vec_id")).limit(max(64, SAMPLE_NUMBERS // dim)).toArrow()
    rotation = fit_rotation(np.asarray(sample.column(0).combine_chunks().flatten()).astype(np.float64).reshape(-1, dim))
    packed = scratch(held.mapInArrow(_pack, "vec_id long, label long, vector binary"), "packed")
    anchors = packed.where(F.col("vec_id") % every == 0)
    asking = anchors.withColumn("windows", F.expr(_ANY))
    near = _cells(packed, asking, ["label"], dim, scratch).applyInArrow(_cell(rotation, dim, True, positives, scores), _FOUND)
    near = scratch(_first(near, positives, "anchor_id").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    # least * p <= 100 * s <= most * p in whole numbers, for p of 0 or more
    low, high = F.expr(f"({least} * positive_score + 99) div 100"), F.expr(f"({most} * positive_score) div 100")
    some = near.where(score >= 0).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("positive_id", low.alias("low"), high.alias("high")))).alias("windows"))
    asking = scratch(anchors.join(some, "vec_id"), "asking")
    wide = _cells(packed, asking.withColumn("windows", F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high")))), [], dim, scratch).applyInArrow(_cell(rotation, dim, False, negatives, scores), _FOUND)
    best = _first(wide, negatives, "anchor_id", "window")
    named = asking.select(F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("window", "w")).select("anchor_id", "window", F.col("w.positive_id").alias("positive_id"))
    told = best.join(named, ["anchor_id", "window"]).join(near, ["anchor_id", "positive_id"])
    return told.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
