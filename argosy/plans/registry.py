"""Where queries register: by name, over the star's snapshot, its tables or its documents, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from argosy.plans import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SCORED = "('supports', 'founds', 'lifts', 'refutes')"


def _sql(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def _level(name: str, seats: str, values: str) -> str:
    """CTEs that fold the seats over the values known so far."""
    return f"""
{name}_s as materialized (select e.target as id, min(case when relation in ('supports', 'founds') then bearing * v end) as premise, max(case when relation = 'lifts' then bearing * v end) as lift,
  min(case when relation = 'refutes' then 1.0::double - bearing * v end) as cap from e join {values} s on e.source = s.id where relation in {SCORED} group by 1),
{name} as materialized (select id, premise, lift, cap, case when held is null or cap is null then held else least(held, cap) end as v from (
  select id, premise, lift, cap, case when d is null then lift when lift is null then d else greatest(d, lift) end as held from (
    select n.id, premise, lift, cap, case when premise is null then case when kind = 'claim' then 0.0::double else rigor end when rigor is not null then least(rigor, premise) end as d
    from n0 n left join {name}_s s on n.id = s.id where {seats})))"""


#: The derived view in SQL: the levels of the star's graph, unrolled.
BASE = f"""with n0 as materialized ({_sql(star.NODES)}),
e as materialized ({_sql(star.EDGES)}),
v0 as materialized (select id, rigor as v from n0 where kind in ('axiom', 'work') or (kind = 'experiment' and status = 'run')),
{_level("l1", "n.id like 'clm-s%' or n.id like 'clm-c%'", "v0")},
v1 as materialized (select * from v0 union all select id, v from l1),
{_level("l2", "n.kind = 'analysis'", "v1")},
v2 as materialized (select * from v1 union all select id, v from l2),
{_level("l3", "n.id like 'clm-p%'", "v2")},
d as (select source, count(distinct target) as dependents from e where relation in {SCORED} group by 1),
lv as (select *, 1 as level from l1 union all select *, 2 from l2 union all select *, 3 from l3),
n as materialized (select n0.*, premise, lift, cap, case when kind in ('claim', 'analysis') then v else rigor end as strength, coalesce(dependents, 0)::bigint as dependents
  from n0 left join lv on n0.id = lv.id left join d on n0.id = d.source)
"""


def on_graph(name: str, sql: str | None, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """A query over the snapshot's nodes and edges."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = star.snapshot(spark, sf_dir)
        return fn(held.nodes, held.edges)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = BASE + sql


def on_records(name: str, sql: str | None, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """A query over the records' nodes and edges, without anything derived."""
    QUERIES[name] = lambda spark, sf_dir: fn(*star.records(spark, sf_dir))
    if sql:
        ORACLES[name] = BASE + sql


def on_tables(name: str, sql: str | None, fn: Callable[..., DataFrame], *tables: str) -> None:
    """A query over some of the tables."""
    QUERIES[name] = lambda spark, sf_dir: fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
    if sql:
        ORACLES[name] = sql


def on_docs(name: str, sql: str | None, fn: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    """A query over the star's documents and the records' nodes and edges, without anything derived; in SQL, `docs` (k, path, text) stands beside `n` and `e`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = star.records(spark, sf_dir)
        return fn(star.documents(spark, sf_dir), held.nodes, held.edges)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"{BASE}, docs as ({_sql(star.DOCUMENTS)}), k as (select *, (select count(*) from part) as n_parts from part)\n{sql}"
