"""Embedding near-dedup by inverted lists and product quantisation.

Unit vectors are indexed by their nearest coarse centroid and by codes of
the residual's subspaces. A query probes its nearest lists, as many as pairs
right at the similarity need by a measurement on the fitted index, and of
these the ones that can hold a vector within the distance at all. Asymmetric
table look-ups give distances to the codes, and all that the codes' own
errors don't rule out are compared exactly, in double precision. The bounds
on distances are the triangle inequality's and lose no link; the number of
probes leaves a pair of the lowest similarity out with a chance of about
1 / ``TRIALS``, and closer ones with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwatch.llm.common import Scratch, materialize
from shoalwatch.llm.components import components
from shoalwatch.llm.minhash import _forest

#: Centroids and codes are fitted on at most this many distinct vectors.
SAMPLE = 16384
#: Lists: one for each so many distinct vectors, up to the bound.
PER_LIST, MOST_LISTS = 256, 1024
#: Pairs at the lowest similarity on which the number of probes is measured.
TRIALS = 4096
SUBSPACES, CODES = 8, 32
#: Vectors and queries of one comparison cell.
BLOCK = 1024
#: Numbers that the vectors of one side of a cell hold at most, for large dimensions.
CELL_NUMBERS = 1 << 20
_ROUNDS, _SEED, _SLACK = 8, 5, 1e-6


@dataclass
class Index:
    centroids: np.ndarray
    #: subspaces x codes x width; the last subspace is padded with zeros
    codebooks: np.ndarray
    #: nearest lists that a query looks at
    probes: int

    @property
    def width(self) -> int:
        return self.codebooks.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows of residuals as rows x subspaces x width."""
        full = np.zeros((len(x), len(self.codebooks) * self.width))
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), len(self.codebooks), self.width)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for each row of x, some rows at a time."""
    return np.concatenate([_distances(x[i : i + BLOCK], c).argmin(1) for i in range(0, len(x), BLOCK)])


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(_ROUNDS):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _probes(x: np.ndarray, centroids: np.ndarray, cosine: float) -> int:
    """Nearest lists among which the partners of ``TRIALS`` made pairs of the cosine all are."""
    rng = np.random.default_rng(_SEED)
    most = 0
    for _ in range(0, TRIALS, BLOCK):
        one = x[rng.integers(len(x), size=BLOCK)]
        away = rng.normal(size=one.shape)
        away -= (away * one).sum(1, keepdims=True) * one
        length = np.linalg.norm(away, axis=1, keepdims=True)
        other = cosine * one + np.sqrt(max(0.0, 1 - cosine**2)) * np.divide(away, length, where=length > 0, out=np.zeros_like(away))
        far = _distances(one, centroids)
        home = _distances(other, centroids).argmin(1)
        most = max(most, int((far < far[np.arange(BLOCK), home][:, None]).sum(1).max()))
    return most + 1


def _unit(arr: pa.Array) -> np.ndarray:
    x = np.asarray(arr.flatten()).astype(np.float64).reshape(len(arr), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, *, cosine: float, sample: int = SAMPLE) -> Index:
    """Fit on the ``sample`` vectors with the smallest hashes; there is one at least."""
    n = vectors.count()
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toArrow()
    x = _unit(rows.column(0).combine_chunks())
    c = _kmeans(x, max(1, min(MOST_LISTS, n // PER_LIST, len(x))))
    residual = x - c[_nearest(x, c)]
    width = -(-x.shape[1] // SUBSPACES)
    index = Index(c, np.zeros((SUBSPACES, min(CODES, len(x)), width)), _probes(x, c, cosine))
    parts = index.split(residual)
    index.codebooks = np.stack([_kmeans(np.ascontiguousarray(parts[:, m]), min(CODES, len(x))) for m in range(SUBSPACES)])
    return index


def _place(index: Index, reach: float):
    """Assign lists and codes, and the lists that each vector has to probe."""
    gaps = np.sqrt(_distances(index.centroids, index.centroids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2))
            d = _distances(x, index.centroids)
            near = d.argmin(1)
            parts = index.split(x - index.centroids[near])
            codes = np.stack([_distances(parts[:, m], index.codebooks[m]).argmin(1) for m in range(len(index.codebooks))], axis=1)
            coded = np.stack([index.codebooks[m][codes[:, m]] for m in range(len(index.codebooks))], axis=1)
            error = np.sqrt(((parts - coded) ** 2).sum((1, 2)))
            # the nearest a vector can come to the border of another list's cell
            with np.errstate(divide="ignore", invalid="ignore"):
                border = (d - d[np.arange(len(x)), near][:, None]) / (2 * gaps[near])
            # a pair of lists is looked at from the one of the smaller number
            closest = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) < index.probes
            probed = closest & ~(border > reach) & (np.arange(len(gaps))[None, :] > near[:, None])
            probes = [[int(n), *np.flatnonzero(p).tolist()] for n, p in zip(near, probed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(near, pa.int32()), pa.array([bytes(r) for r in codes.astype(np.uint8)], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))],
                names=["rep", "m", "embedding", "list", "code", "error", "probes"],
            )

    return place


def _compare(index: Index, least: float, reach: float):
    def compare(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("query"))
        c = index.centroids[table.column("list")[0].as_py()]
        x_rows, q_rows = table.filter(pa.array(~role)), table.filter(pa.array(role))
        out = {"a": [], "b": [], "n": []}
        if x_rows.num_rows and q_rows.num_rows:
            x, q = (_unit(t.column("embedding").combine_chunks()) for t in (x_rows, q_rows))
            xr, qr, xm, qm = (np.asarray(t.column(k)) for k in ("rep", "m") for t in (x_rows, q_rows))
            code = np.frombuffer(b"".join(x_rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            parts = index.split(q - c)
            far = np.zeros((len(q), len(x)))
            for k in range(len(index.codebooks)):
                far += _distances(parts[:, k], index.codebooks[k])[:, code[:, k]]
            maybe = np.sqrt(far) <= reach + np.asarray(x_rows.column("error"))[None, :]
            own = np.asarray(q_rows.column("own"))
            maybe &= ~own[:, None] | (qr[:, None] < xr[None, :])
            i, j = np.nonzero(maybe)
            cosine = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.empty(0)])
            i, j = i[cosine >= least], j[cosine >= least]
            links = np.concatenate((np.bincount(i, xm[j], len(q)), np.bincount(j, qm[i], len(x)))).astype(np.int64)
            reps = np.concatenate((qr, xr))
            some = links > 0
            out = {"a": reps[some].tolist(), "b": [None] * int(some.sum()), "n": links[some].tolist()}
            for a, b in _forest(i, j + len(q)):
                out["a"].append(int(reps[a]))
                out["b"].append(int(reps[b]))
                out["n"].append(0)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return compare


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, cosine: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """Link vectors with a cosine of ``cosine`` or more.

    Returns per row ``vec_id, n_links`` (other vectors linked directly),
    ``component_id`` (the smallest vec_id reachable), ``kept``. Vectors that
    are null, empty, zero, or hold null or non-finite components link with
    nothing; vectors of different dimensions don't link, each dimension has
    an index of its own. Rows with one vec_id count as one node of
    components. A row with a null vec_id links with nothing and has a null
    component. An empty table gives an empty result.

    Equal vectors make one class with a weight, known by a 128-bit digest;
    classes are compared in cells of bounded size, of which only sums of
    links and a spanning forest come out. The indexes are fitted on bounded
    samples and hold every row.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    # scaled by the largest component, so that no norm over- or underflows; + 0.0 makes one of both zeros
    top = F.array_max(F.transform("embedding", F.abs))
    rows = rows.withColumn("embedding", F.when(usable, F.transform("embedding", lambda v: v / top + F.lit(0.0))))
    digest = F.when(F.col("embedding").isNotNull(), F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(1), "embedding").alias("y")))
    rows = rows.withColumn("digest", digest)
    scratch = Scratch()
    keys = materialize(rows.select("vec_id", "digest"), "keys")
    grouped = rows.where(F.col("digest").isNotNull()).groupBy("digest")
    classes = scratch(grouped.agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    dims = [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").collect()]
    found = None
    for dim in dims:
        links = _links(classes.where(F.col("dim") == dim).select("rep", "m", "embedding"), dim, cosine, sample, scratch)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = found.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "rep")
    labels = components(found.where("b is not null").select("a", "b").union(_same_vector(keys, classes)))
    told = classes.join(links, "rep", "left").join(labels, F.col("rep") == labels["node"], "left")
    told = materialize(told.select(F.col("digest").alias("of"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "labelled")
    scratch.clear()
    out = keys.join(told, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, dim: int, cosine: float, sample: int, scratch: Scratch) -> DataFrame:
    """``a, n`` (classes and the links of each) and ``a, b`` (a spanning forest) of one dimension."""
    index = fit(classes, cosine=cosine, sample=sample)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _SLACK
    placed = scratch(classes.mapInArrow(_place(index, reach), "rep long, m long, embedding array<double>, list int, code binary, error double, probes array<int>"), "placed")
    block = max(16, min(BLOCK, CELL_NUMBERS // dim))
    blocks = lambda n: F.ceil(n / block).cast("int")
    held = placed.groupBy("list").agg(blocks(F.count(F.lit(1))).alias("nx"))
    asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(blocks(F.count(F.lit(1))).alias("nq"))
    sizes = F.broadcast(held.join(asked, "list"))  # one row per list, MOST_LISTS at most
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["list", "i", "j", "query", "own", "rep", "m", "embedding", "code", "error"]
    base = placed.join(sizes, "list").withColumn("i", F.pmod(F.xxhash64("rep"), "nx").cast("int")).withColumn("j", spread(F.col("nq"))).withColumns({"query": F.lit(False), "own": F.lit(True)}).select(columns)
    ask = placed.withColumnRenamed("list", "home").withColumn("list", F.explode("probes")).join(sizes, "list")
    ask = ask.withColumn("j", F.pmod(F.xxhash64("rep"), "nq").cast("int")).withColumn("i", spread(F.col("nx"))).withColumns({"query": F.lit(True), "own": F.col("home") == F.col("list"), "code": F.lit(None).cast("binary"), "error": F.lit(0.0)}).select(columns)
    return scratch(base.union(ask).groupBy("list", "i", "j").applyInArrow(_compare(index, cosine, reach), "a long, b long, n long"), "links")


def _same_vector(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a vec_id."""
    some = keys.where(F.col("digest").isNotNull())
    twice = some.groupBy("vec_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("vec_id")
    return some.join(twice, "vec_id").join(classes.select("rep", "digest"), "digest").where("rep != vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
