"""Connected components of a table of edges, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each node's
neighbours are linked to the least node of its neighbourhood, until every component is a star about its least node. The
number of rounds grows with the logarithm of the component's size; each round's edges are settled in the shared folder. A
node's least neighbour is an aggregate that tasks combine first; the edges of a hub are joined with its one row, and AQE
splits the hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.plans.star import settle


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least neighbour of every u of edges (u, v). Settled, so that joins with it deal both sides anew."""
    return settle(edges.groupBy("u").agg(F.min("v").alias("m"))).withColumnRenamed("u", "_u")


def large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of u to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), F.col("u") == F.col("_u"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "_u").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links u and its lesser neighbours to the least of them. Edges have u > v."""
    joined = edges.join(_least(edges), F.col("u") == F.col("_u"))
    return joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """u, v: every node of `edges` (u, v) but the least of its component, and that least node. Loops and nulls count for nothing."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = settle(edges)
    mark = _mark(edges)
    while mark[0]:
        edges = settle(small_star(settle(large_star(edges))))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges
