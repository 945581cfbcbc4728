"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging.

Queries are dealt to tiles and vectors to shards, both of bounded size; each pair of a tile and a shard is one task that
multiplies two matrices and keeps each query's k best of the shard. The lists are then merged in a tree of bounded fan-in.
Nothing is broadcast: the query set may grow with the table.

Components are scaled and floored to integers first, so scores are exact: products run in float64 where every partial sum
is below 2**53, else in Python integers (scores are then held to the range of a long).

Defined results: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part;
vectors meet only those of their own length; all rows with the query's id are its own; rows that repeat a query's id and
vector are one query; repeated candidates each count; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_TILE, SHARD_ROWS, FAN_IN = 8192, 4096, 16
PARTIAL = "query_id long, _form long, _shard int, vec_id long, score long"


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, null where the vector can take no part."""
    fits = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(fits, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a and b."""
    top = max(map(int, (abs(a.min()), abs(a.max())))) * max(map(int, (abs(b.min()), abs(b.max())))) * a.shape[1]
    if 0 <= top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_of_tile(k: int):
    """For one tile of queries and one shard of vectors: each query's k best rows of the shard."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if queries.num_rows and vectors.num_rows:
            ids = np.asarray(vectors["_id"].combine_chunks())
            order = np.argsort(ids, kind="stable")
            ids, b, a = ids[order], matrix(vectors["_v"])[order], matrix(queries["_v"])
            names, forms, shard = np.asarray(queries["_id"].combine_chunks()), np.asarray(queries["_form"].combine_chunks()), vectors["_shard"][0].as_py()
            for at in range(0, len(a), 512):
                scores = products(a[at : at + 512], b)
                for i, row in enumerate(scores):
                    open_to = np.flatnonzero(ids != names[at + i])
                    values = row[open_to]
                    if len(values) > k:  # partial selection; ties at the k-th value go to smaller ids, which come first
                        kth = np.partition(values, len(values) - k)[len(values) - k]
                        above, level = np.flatnonzero(values > kth), np.flatnonzero(values == kth)
                        keep = np.concatenate([above, level[: k - len(above)]])
                        open_to, values = open_to[keep], values[keep]
                    n = len(values)
                    for column, x in zip(out, (np.full(n, names[at + i]), np.full(n, forms[at + i]), np.full(n, shard, np.int32), ids[open_to], values), strict=True):
                        column.append(x)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(np.concatenate(x) if x else [], t) for n, x, t in zip(("query_id", "_form", "_shard", "vec_id", "score"), out, types, strict=True)})

    return run


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows, ties to the smaller id."""
    form = lambda df: df.select(F.col(id_col).cast("long").alias("_id"), integers(F.col(vector_col), scale).alias("_v")).where("_id is not null and _v is not null").withColumn("_dim", F.size("_v"))
    asked, held = form(queries).withColumn("_form", F.xxhash64("_v")).dropDuplicates(["_id", "_form"]), form(vectors)
    n_tiles, n_shards = max(1, -(-asked.count() // QUERY_TILE)), max(1, -(-held.count() // SHARD_ROWS))
    # Rows that share an id may be a third of a table, so queries and vectors are dealt by their content and id together.
    dealt = lambda n: F.pmod(F.xxhash64("_id", "_v", F.lit(n)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("_tile", dealt(n_tiles)).withColumn("_shard", each(n_shards))
    held = held.withColumn("_shard", dealt(n_shards)).withColumn("_tile", each(n_tiles))
    keys = ["_tile", "_shard", "_dim"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best_of_tile(k), PARTIAL)
    lists, width = found.groupBy("query_id", "_form", "_shard").agg(_best(F.collect_list(_item()), k)), n_shards
    while width > 1:
        width = -(-width // FAN_IN)
        lists = lists.withColumn("_shard", (F.col("_shard") / FAN_IN).cast("int")).groupBy("query_id", "_form", "_shard").agg(_best(F.flatten(F.collect_list("_best")), k))
    return lists.select("query_id", F.posexplode("_best").alias("_at", "_x")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))


def _item() -> Column:
    # ~score = -score - 1 falls as the score rises and has no overflow
    return F.struct(F.bitwise_not("score").alias("down"), "vec_id", "score")


def _best(items: Column, k: int) -> Column:
    return F.slice(F.sort_array(items), 1, k).alias("_best")
