"""Centroid clustering (k-means) with Elkan's bounds.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to each of the k centroids.
After the centroids have moved, the bounds are widened by the moves. A vector whose upper bound is below half the distance from its
centroid to the nearest other one needs no distance at all; else only centroids are measured whose lower bound, and half whose distance
from the vector's own, do not exceed the upper bound. Upper bounds are rounded up and lower ones down, and a centroid is left out only
when it is farther for certain (strictly), so ties stay candidates and go to the smaller number. What is measured is compared as exact
integers.

Rows with their bounds are written to the shared folder once a round (the round before the last is removed), so a lost executor costs
the tasks it held. Sums of a cluster are taken by partition, then by cluster; only k sums, k distances and the centroids themselves
(k * dim integers, bounded by parameters) meet on the driver and travel to the tasks.

Components are floor(scale * x) as integers of any size: arrays of doubles where all differences, squared and summed, are below 2**53,
Python integers with trivial bounds elsewhere.

Defined results: vectors that are null, of another length than `dim`, or hold null or non-finite components take no part; a null id is
a value like others; rows that repeat are vectors of their own; initial centroids whose ids repeat go by the components; with fewer
vectors than k each is a centroid; equal centroids are settled by the number, the later stays empty and where it is; distances and
their sums beyond a long are held to its greatest value; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import remove, sha256_hex, shared_dir

#: Doubles hold all squared distances of components below this, up to 128 of them.
PLAIN = 2.0**22
#: A relative margin above the error of a conversion and a square root.
MARGIN = 2.0**-50
MOST = 2**63 - 1


def whole_vectors(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """_id and _v of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).where((F.size("_v") == dim) & F.forall("_v", finite))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that hold small integers exactly, else Python integers."""
    with np.errstate(over="ignore"):
        found = np.floor(values.astype(np.float64) * scale)
    if not found.size or np.abs(found).max() < PLAIN:
        return found
    exact = [math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in values.astype(np.float64).ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a from b."""
    apart = a - b
    return (apart * apart).sum(axis=1) if apart.dtype == object else np.einsum("ij,ij->i", apart, apart)


def _plain(a: np.ndarray, *others: np.ndarray) -> bool:
    return a.dtype != object and all(not o.size or abs(o).max() < PLAIN for o in others)


class Round:
    """The centroids of one round with what the bounds need: their moves since the last one and the halves of their distances."""

    def __init__(self, centroids: list[list[int]], last: list[list[int]] | None = None):
        exact = np.array(centroids, dtype=object)
        self.plain = not exact.size or max(map(abs, exact.ravel().tolist())) < PLAIN and (last is None or max(abs(x) for c in last for x in c) < PLAIN)
        self.centroids = exact.astype(np.float64) if self.plain else exact
        k = len(centroids)
        self.moved = np.zeros(k)
        self.half = np.full((k, k), np.inf)
        if self.plain:
            if last is not None:
                self.moved = np.sqrt(squared(self.centroids, np.array(last, dtype=np.float64))) * (1 + MARGIN)
            for j in range(k):
                self.half[j] = np.sqrt(squared(self.centroids, self.centroids[j])) / 2 * (1 - MARGIN)
                self.half[j, j] = np.inf
        self.near = self.half.min(axis=1) if k else np.zeros(0)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple:
        """cluster, upper, lower, distance (0 where it wasn't needed and `exact` is false) and the number of distances measured."""
        n, k = len(x), len(self.centroids)
        measured = np.zeros(n, np.int64)
        if not (self.plain and x.dtype != object):
            held = self.centroids.astype(object)
            all_of = np.stack([squared(x.astype(object), c) for c in held], axis=1) if n else np.zeros((0, k), object)
            own = np.array([min(range(k), key=row.__getitem__) for row in all_of.tolist()], np.int32)
            best = [min(int(row[c]), MOST) for row, c in zip(all_of.tolist(), own, strict=True)]
            return own, np.full(n, np.inf), np.zeros((n, k), np.float32), np.array(best, np.int64), np.full(n, k, np.int64)
        fresh = own < 0
        own = np.where(fresh, 0, own)
        upper = np.where(fresh, np.inf, (upper + self.moved[own]) * (1 + MARGIN))
        lower = np.maximum(0.0, (lower.astype(np.float64) - self.moved) * (1 - MARGIN)) if len(self.moved) else lower
        best = np.zeros(n)
        asked = np.flatnonzero(np.ones(n, bool) if exact else upper >= self.near[own])
        best[asked] = np.concatenate([squared(x[asked[i : i + 4096]], self.centroids[own[asked[i : i + 4096]]]) for i in range(0, len(asked), 4096)] or [best[:0]])
        measured[asked] += 1
        root = np.sqrt(best[asked])
        upper[asked] = root * (1 + MARGIN)
        lower[asked, own[asked]] = root * (1 - MARGIN)
        left = asked[upper[asked] >= self.near[own[asked]]]
        first, bound = own.copy(), upper.copy()
        for j in range(k):
            rows = left[(lower[left, j] <= bound[left]) & (self.half[first[left], j] <= bound[left]) & (first[left] != j)]
            if len(rows):
                found = squared(x[rows], self.centroids[j])
                measured[rows] += 1
                lower[rows, j] = np.sqrt(found) * (1 - MARGIN)
                wins = (found < best[rows]) | ((found == best[rows]) & (j < own[rows]))
                best[rows[wins]], own[rows[wins]] = found[wins], j
        changed = np.flatnonzero(own != first)
        upper[changed] = np.sqrt(best[changed]) * (1 + MARGIN)
        return own, upper, np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), best.astype(np.int64), measured


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _assigned(state: DataFrame, now: Round, scale: int, exact: bool, out: StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = integers(_matrix(batch.column(1), len(now.centroids[0])), scale)
                own, upper, lower = np.asarray(batch.column(2)), np.asarray(batch.column(3)).copy(), _matrix(batch.column(4), len(now.centroids)).copy()
                own, upper, lower, best, measured = now.assign(x, own, upper, lower, exact)
                flat = pa.ListArray.from_arrays(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32), pa.array(lower.ravel(), pa.float32()))
                made = [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(upper), flat, pa.array(best), pa.array(np.asarray(batch.column(6)) + measured)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return state.mapInArrow(run, out)


def _sums(state: DataFrame, scale: int, dim: int) -> list[tuple[int, int, list[int]]]:
    """cluster, count and componentwise sum of every cluster that has vectors: at most k rows."""

    def partial(batches):
        held: dict[int, list] = {}
        for batch in batches:
            x, own = integers(_matrix(batch.column(1), dim), scale), np.asarray(batch.column(0))
            for c in np.unique(own):
                rows = x[own == c]
                total = [int(t) for t in rows.sum(axis=0)]  # doubles are exact: 2**22 times a batch's rows
                n, before = held.get(int(c), (0, [0] * dim))
                held[int(c)] = (n + len(rows), [a + b for a, b in zip(before, total, strict=True)])
        rows = [(c, n, ",".join(map(str, total))) for c, (n, total) in held.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("c", "n", "sums"), r, strict=True)) for r in rows], pa.schema([("c", pa.int32()), ("n", pa.int64()), ("sums", pa.string())]))

    def merged(table: pa.Table) -> pa.Table:
        total = [0] * dim
        for sums in table["sums"].to_pylist():
            total = [a + int(b) for a, b in zip(total, sums.split(","), strict=True)]
        return pa.table({"c": table["c"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "sums": [",".join(map(str, total))]})

    form = "c int, n long, sums string"
    rows = state.select("_c", "_v").mapInArrow(partial, form).groupBy("c").applyInArrow(merged, form).collect()
    return [(r.c, r.n, [int(x) for x in r.sums.split(",")]) for r in rows]


def cluster(vectors: DataFrame, k: int, rounds: int, rank: Column, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia, centroid (its components as text, joined by commas), n_measured (distances computed for the vector in all rounds).

    The k vectors of the least `rank` (an expression over `vectors`) are the first centroids, in its order. Each round assigns every
    vector and then moves every centroid that has vectors to the floor of their mean; vectors are assigned once more at the end.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors.select(F.struct(rank.alias("rank"), F.col(id_col).alias("id")).alias("_id"), F.col(vector_col)), dim, "_id", vector_col)
    first = kept.orderBy("_id.rank", F.col("_v").cast("array<double>")).limit(k).collect()
    centroids = [[int(x) for x in row] for row in integers(np.array([r["_v"] for r in first], np.float64).reshape(len(first), dim), scale).tolist()]
    state = kept.select(F.col("_id.id").alias("_id"), "_v", F.lit(-1).alias("_c"), F.lit(0.0).alias("_u"), F.array_repeat(F.lit(0.0).cast("float"), len(centroids)).alias("_l"), F.lit(0).cast("long").alias("_d"), F.lit(0).cast("long").alias("_n"))
    out, root, last = state.schema, f"{shared_dir(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}", None
    for i in range(rounds + 1 if centroids else 0):
        _assigned(state, Round(centroids, last), scale, i == rounds, out).write.parquet(f"{root}/{i}")
        state = spark.read.schema(out).parquet(f"{root}/{i}")
        if i:
            remove(spark, f"{root}/{i - 1}")
        if i < rounds:
            last, centroids = centroids, [list(c) for c in centroids]
            for c, n, total in _sums(state, scale, dim):
                centroids[c] = [x // n for x in total]
    totals = {r["_c"]: int(r["d"]) for r in state.groupBy("_c").agg(F.sum(F.col("_d").cast("decimal(38,0)")).alias("d")).collect()} if centroids else {}  # k rows
    held = lambda x: min(x, MOST)
    rows = [(c, held(totals.get(c, 0)), held(sum(totals.values())), ",".join(map(str, centroid))) for c, centroid in enumerate(centroids)]
    named = spark.createDataFrame(rows, "_k int, cluster_inertia long, inertia long, centroid string")
    found = state.join(F.broadcast(named), F.col("_c") == F.col("_k"))  # k rows
    return found.select(F.col("_id").alias(id_col), F.col("_c").alias("cluster"), F.col("_d").alias("distance"), "cluster_inertia", "inertia", "centroid", F.col("_n").alias("n_measured"))


def seeded_rank(seed: int, id_col: str = "vec_id") -> Column:
    """The hex SHA-256 of `seed:id`: a rank that picks initial centroids alike on every run."""
    return sha256_hex(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def digest(centroid: str) -> str:
    return hashlib.sha256(centroid.encode()).hexdigest()
