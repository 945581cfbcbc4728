"""Graph loops over whole edge tables: the star's customers in rings of ten, each with chords, a way back and two analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.operators import graph
from argosy.plans.registry import on_tables
from argosy.plans.star import CLC

_C = CLC("(c_custkey + {0})")
_STEPS = ((1, "c_custkey % 10 < 9"), (2, "c_custkey % 10 < 8"), (-9, "c_custkey % 10 = 9"))
_EDGES = " union all ".join(f"select 'supports' as relation, {_C.format(0)} as source, {_C.format(step)} as target from {{customer}} where {held}" for step, held in _STEPS)
_SQL = "with g as (" + _EDGES.replace("{customer}", "customer") + f"), z as (select {_C.format(0)} as id, c_custkey as k from customer)"
_full = "where k % 10 = 0 and k + 9 < (select count(*) from customer)"


def _rings(c: DataFrame) -> DataFrame:
    return c.sparkSession.sql(_EDGES, customer=c)


def _kinds(c: DataFrame) -> DataFrame:
    return c.selectExpr(f"{_C.format(0)} as id", "case when c_custkey % 10 in (4, 7) then 'analysis' else 'claim' end as kind")


def _at(k: str) -> str:
    return CLC(f"({k})")


def _cuts(pairs: list[tuple[int, int]], order: str) -> str:
    cut = ", ".join(f"{{'s': {_at(f'k + {a}')}, 't': {_at(f'k + {b}')}, 'i': {i}}}" for i, (a, b) in enumerate(pairs))
    return f"{_SQL}, x as (select k, unnest([{cut}]) as c from z {_full}) select row_number() over (order by {order})::int as rank, 'supports' as relation, c.s as source, c.t as target from x"


# Cuts: the first edge into an analysis of the first cycle, then of the next, then the closing edge.
on_tables("cycle_cuts", _cuts([(3, 4), (6, 7), (9, 0)], "k, c.i"), lambda c: graph.cycle_cuts(_rings(c), _kinds(c)), "customer")
# Walked from the sixth of each ring on, by falling rank of the rings: its first edges lead 5 6 7 8 9 0 1 2 3 4 5.
on_tables(
    "cycle_cuts_hosted",
    _cuts([(9, 0)], "-k, c.i"),
    lambda c: graph.cycle_cuts(_rings(c), _kinds(c).withColumn("kind", F.lit("claim")), c.where("c_custkey % 10 = 0").selectExpr(f"{_C.format(0)} as id", "1000000000 - c_custkey as rank")),
    "customer",
)
_acyclic = lambda c: _rings(c).where("source < target")
on_tables(
    "transitive_reduction",
    f"""{_SQL} select 'supports' as relation, {_C.format(0)} as source, {_C.format(1)} as target
      from customer where c_custkey % 10 < 9 and c_custkey + 1 < (select count(*)
      from customer)""",
    lambda c: graph.transitive_reduction(_acyclic(c).join(_kinds(c).select(F.col("id").alias("target")), "target", "left_semi").select("relation", "source", "target")),
    "customer",
)
on_tables(
    "shortest_path",
    f"""{_SQL}, r as (with recursive w(id, path) as (select {_at('0')}, [{_at('0')}]
      union all select g.target, list_append(path, g.target) from w join g on g.source = w.id
      where g.source < g.target and len(path) < 10 and w.id <> {_at('9')}) select path
      from w where id = {_at('9')} order by len(path), list_reverse(path) limit 1)
  select unnest(path) as id, generate_subscripts(path, 1)::int as rank
      from r""",
    lambda c: c.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(graph.shortest_path(_acyclic(c), "clm-c00000", "clm-c00009"))], "id string, rank int"),
    "customer",
)
on_tables(
    "strong_parts",
    f"{_SQL} select id, {_at('k - k % 10')} as part from z where k - k % 10 + 9 < (select count(*) from customer)",
    lambda c: graph.strong_parts(_rings(c).select("source", "target")),
    "customer",
)
