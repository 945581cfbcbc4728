"""Every registered query of the claim graph, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.functions import graph as G
from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.operators import build, graph, query, render, score, strength, verify
from argosy.plans import star
from argosy.plans.registry import ORACLES, QUERIES, SCORED, on_graph, on_tables
from argosy.streaming import ledger

_FOUND = "select id, kind, title, label, host, strength, dependents from n"
_RANK = "case relation when 'supports' then 0 when 'founds' then 1 when 'lifts' then 2 when 'refutes' then 3 when 'references' then 4 else 5 end"
_TEXT = "case when bearing_pending then 'pending' else bearing::varchar end"
_BAND = "case when strength is null then 'unknown' when strength >= 0.85::double then 'ok-to-build' when strength >= 0.65::double then 'ok-with-caveats' when strength >= 0.45::double then 'input-only' when strength >= 0.2::double then 'do-not-build' else 'unsubstantiated' end"


# find
on_graph("find_all", _FOUND, lambda n, e: query.find(n))
on_graph("find_kind", f"{_FOUND} where kind in ('work', 'axiom')", lambda n, e: query.find(n, kinds=["work", "axiom"]))
on_graph("find_title_contains", f"{_FOUND} where contains(lower(title), 'bolt')", lambda n, e: query.find(n, title="BOLT"))
on_graph("find_label", f"{_FOUND} where contains(lower(label), 'nation_1')", lambda n, e: query.find(n, label="Nation_1"))
on_graph("find_path_prefix", f"{_FOUND} where host = 'parts' or starts_with(host, 'parts/')", lambda n, e: query.find(n, path="parts/"))
on_graph("find_strength_range", f"{_FOUND} where strength >= 0.25::double and strength < 0.5::double", lambda n, e: query.find(n, low=0.25, high=0.5))
on_graph("find_pending", f"{_FOUND} where strength is null", lambda n, e: query.find(n, pending=True))
on_graph("find_min_dependents", f"{_FOUND} where dependents >= 20", lambda n, e: query.find(n, min_dependents=20))
on_graph(
    "find_sort_strength_desc",
    f"select *, row_number() over (order by strength desc nulls last, id)::int as rank from ({_FOUND} where kind = 'claim') qualify rank <= 25",
    lambda n, e: query.find(n, kinds=["claim"], sort="strength", order="desc", limit=25),
)
on_graph(
    "find_sort_dependents",
    f"select *, row_number() over (order by dependents desc, strength nulls first, id)::int as rank from ({_FOUND}) qualify rank <= 25",
    lambda n, e: query.find(n, sort="dependents", order="desc", limit=25),
)
on_graph(
    "find_limit_negative",
    f"""select * exclude (back), row_number() over (order by back desc)::int as rank
      from (select *, row_number() over (order by id desc) as back from ({_FOUND}))
      where back <= 7""",
    lambda n, e: query.find(n, sort="id", limit=-7),
)
# edges
_EDGE = "select relation, replaced_relation, source, target, context, bearing, bearing_pending from e"
on_graph("edges_all", _EDGE, lambda n, e: query.edges_of(e))
on_graph("edges_in", f"{_EDGE} where target = 'clm-p00007'", lambda n, e: query.edges_of(e, id="clm-p00007", direction="in"))
on_graph("edges_out", f"{_EDGE} where source = 'clm-s00003'", lambda n, e: query.edges_of(e, id="clm-s00003", direction="out"))
on_graph("edges_relation", f"{_EDGE} where relation in ('founds', 'demoted')", lambda n, e: query.edges_of(e, relations=["founds", "demoted"]))
on_graph("edges_pending", "select relation, source, target from e where bearing_pending", lambda n, e: e.where("bearing_pending").select("relation", "source", "target"))
for _name, _id in (("show_claim", "clm-p00007"), ("show_analysis", "ana-000012"), ("show_experiment", "exp-000005"), ("show_axiom", "axm-000001"), ("show_work", "wrk-000003")):
    on_graph(
        _name,
        f"select id, kind, title, label, status, rigor, manually_scored, host, strength, dependents, {_BAND} as band, (select count(*) from e where target = '{_id}') as edges_in, (select count(*) from e where source = '{_id}') as edges_out from n where id = '{_id}'",
        lambda n, e, i=_id: query.show(n, e, i),
    )
_HEAD = ("kind", "id", "title", "host", "summary")
_VALUE = {
    "summary": "split_part(host, '/', 1) || '/summary.md'", "rigor": "coalesce(rigor::varchar, 'pending')", "manually-scored": "coalesce(manually_scored, false)::varchar", "strength": "case when strength is null then 'pending' else format('{:.2f}', strength) end",
    "strength-band": _BAND, "rationale": "''", "premises": "(select count(*) from e where target = n.id and relation in ('supports', 'founds'))::varchar",
}
_BULLET = "concat_ws(' ', relation, source, target, case when bearing_pending then 'pending' else bearing::varchar end, case when manually_scored then '(manual)' end)"
for _name, _id in (("show_record_claim", "clm-p00007"), ("show_record_analysis", "ana-000012"), ("show_record_experiment", "exp-000005"), ("show_record_axiom", "axm-000001"), ("show_record_work", "wrk-000003")):
    _keys = (*_HEAD, *query.SHOWN[_name.rpartition("_")[2]])
    on_graph(
        _name,
        "select x.a::int as \"at\", x.k as key, x.v as value from (select unnest([" + ", ".join(f"{{'a': {_i}, 'k': '{_k}', 'v': ({_VALUE.get(_k, _k)})::varchar}}" for _i, _k in enumerate(_keys)) + f"]) as x from n where id = '{_id}')"
        + "".join(f" union all select ({_n} + {_RANK})::int, '{_k}', {_BULLET} from e where {_c} = '{_id}'" for _n, _k, _c in ((100, "edge-in", "target"), (200, "edge-out", "source"))),
        lambda n, e, i=_id: query.show_record(n, e, i),
    )
# stats
on_graph("stats_kind_counts", "select kind, count(*) as n from n group by 1", lambda n, e: query.kind_counts(n))
on_graph(
    "stats_bands",
    f"""select rank, b.band, coalesce(n, 0)::bigint as n from (values (1, 'ok-to-build'), (2, 'ok-with-caveats'), (3, 'input-only'), (4, 'do-not-build'), (5, 'unsubstantiated'), (6, 'unknown')) b(rank, band)
      left join (select {_BAND} as band, count(*) as n from n where kind = 'claim'
      group by 1) x on b.band = x.band""",
    lambda n, e: query.band_counts(n),
)
on_graph(
    "stats_relation_census",
    f"""select rank, b.relation, walked, coalesce(n, 0)::bigint as n, case when scoring then coalesce(distinct_bearings, 0) end as distinct_bearings, case when scoring then coalesce(pending, 0) end::bigint as pending,
  case when scoring then least end as least, case when scoring then most end as most
  from (values (1, 'supports', true, true), (2, 'founds', false, true), (3, 'lifts', true, true), (4, 'refutes', true, true), (5, 'references', false, false), (6, 'demoted', false, false)) b(rank, relation, walked, scoring)
  left join (select relation, count(*) as n, count(distinct {_TEXT}) as distinct_bearings, count(*) filter (bearing_pending) as pending, min(bearing) as least, max(bearing) as most
      from e group by 1) x on b.relation = x.relation""",
    lambda n, e: query.relation_census(e),
)
on_graph(
    "stats_bearing_counts",
    f"select relation, bearing, bearing_pending, count(*) as n from e where relation in {SCORED} group by 1, 2, 3",
    lambda n, e: query.bearing_counts(e),
)
on_graph(
    "stats_manual_model",
    """select 'rigor' as item, count(*) filter (manually_scored) as manual, count(*) filter (not manually_scored) as model
      from n where kind in ('claim', 'analysis', 'experiment') union all select 'bearing', count(*) filter (manually_scored), count(*) filter (not manually_scored)
      from e where relation in ('supports', 'lifts', 'refutes')""",
    lambda n, e: query.provenance_counts(n, e),
)
on_graph(
    "stats_volume_aggregates",
    """select split_part(host, '/', 1) as volume, count(*) filter (kind = 'claim') as claims, count(*) filter (kind = 'experiment') as experiments
      from n where host is not null group by 1""",
    lambda n, e: query.volume_counts(n),
)
on_graph(
    "highest_leverage",
    """select id, title, strength, dependents, row_number() over (order by dependents desc, strength, id)::int as rank
      from n where kind = 'claim' and strength < 0.65::double and dependents >= 1
      qualify rank <= 10""",
    lambda n, e: query.highest_leverage(n),
)
on_graph(
    "weakest",
    """select id, title, strength, row_number() over (order by strength, id)::int as rank
      from n where kind = 'claim' and strength is not null qualify rank <= 10""",
    lambda n, e: query.weakest(n),
)
on_graph(
    "dependents",
    f"select source as id, count(distinct target) as dependents from e where relation in {SCORED} group by 1",
    lambda n, e: n.where("dependents > 0").select("id", "dependents"),
)
_CONTRIBUTED = f"select e.relation, e.source, e.target, bearing, strength as source_strength, coalesce(kind = 'experiment' and status <> 'run', false) as excluded, case when coalesce(kind = 'experiment' and status <> 'run', false) then null when relation = 'refutes' then 1.0::double - bearing * strength else bearing * strength end as contribution from e left join n on e.source = n.id where relation in {SCORED}"
on_graph("contributions", _CONTRIBUTED, query.contributions)
on_graph(
    "strength_claims",
    "select id, premise, lift, cap, strength from n where kind = 'claim'",
    lambda n, e: n.where("kind = 'claim'").select("id", "premise", "lift", "cap", "strength"),
)
on_graph(
    "strength_analyses",
    "select id, premise, lift, cap, strength from n where kind = 'analysis'",
    lambda n, e: n.where("kind = 'analysis'").select("id", "premise", "lift", "cap", "strength"),
)
_SHOWN = "case when {0} is null then 'pending' else format('{{:.2f}}', {0}) end"
_D = "case when premise is null then case when kind = 'claim' then 0.0::double else rigor end when rigor is not null then least(rigor, premise) end"
on_graph(
    "strength_trace_text",
    f"""select id, coalesce(case when cap is not null and strength is not null then 'min(' || lifted || ', ' || {_SHOWN.format('cap')} || ')' when lift is not null or premise is not null then lifted end, '') as trace
      from (
  select *, case when lift is null then core when rigor is null then 'lift ' || {_SHOWN.format('lift')} else 'max(' || coalesce(core, '') || ', ' || {_SHOWN.format('lift')} || ')' end as lifted
      from (
  select *, case when premise is not null and rigor is not null then 'min(' || {_SHOWN.format('rigor')} || ', ' || {_SHOWN.format('premise')} || ')' when der is not null then {_SHOWN.format('der')} end as core
      from (
  select *, {_D} as der from n where kind in ('claim', 'analysis'))))""",
    lambda n, e: strength.trace_text(n),
)
on_graph(
    "display_strength",
    f"select id, {_SHOWN.format('strength')} as shown, {_BAND} as band from n where kind = 'claim'",
    lambda n, e: n.where("kind = 'claim'").select("id", G.display(F.col("strength")).alias("shown"), G.band(F.col("strength")).alias("band")),
)


def _traced(id: str, near: str, far: str) -> str:
    return f""", r as (with recursive w(id, depth) as (select '{id}', 0 union select e.{far}, depth + 1 from w join e on e.{near} = w.id where e.relation in {SCORED} and depth < 8) select id, min(depth) as depth from w group by 1),
c as ({_CONTRIBUTED})
select c.relation, c.source, c.target, (r.depth + 1)::int as depth, source_strength as strength, contribution, excluded from c join r on c.{near} = r.id"""


on_graph("trace_in", _traced("clm-p00007", "target", "source"), lambda n, e: query.trace(n, e, "clm-p00007", "in"))
on_graph("trace_out", _traced("exp-000001", "source", "target"), lambda n, e: query.trace(n, e, "exp-000001", "out"))
_IN = _traced("clm-p00007", "target", "source").rpartition("select c.relation")
on_graph(
    "trace_by_contribution",
    f"""{_IN[0]}, t as (select c.relation{_IN[2]}) select *, row_number() over (order by excluded, contribution desc nulls last, depth, {_RANK}, source, target)::int as rank
      from t qualify rank <= 20""",
    lambda n, e: query.trace(n, e, "clm-p00007", "in", sort="contribution", order="desc", limit=20),
)
on_graph(
    "scoring_set_rigor",
    "select 1 as part, id as source, manually_scored from n where kind not in ('work', 'axiom')",
    lambda n, e: query.scoring_set(n, e).where("part = 1").select("part", "source", "manually_scored"),
)
on_graph(
    "scoring_set_bearing",
    "select 2 as part, relation, source, target, manually_scored from e where relation in ('supports', 'lifts', 'refutes')",
    lambda n, e: query.scoring_set(n, e).where("part = 2"),
)
# graph
_LEVELS = f""", w as (with recursive r(id, depth) as (select distinct source, 0 from e where relation in {SCORED} and source not in (select target from e where relation in {SCORED})
  union select e.target, depth + 1 from r join e on e.source = r.id where e.relation in {SCORED}) select id, max(depth)::int as level from r group by 1) select * from w"""
_scored = lambda e: e.where(G.scoring(F.col("relation")))
on_graph("topo_levels", _LEVELS, lambda n, e: graph.levels(_scored(e)))
on_graph(
    "closure_axioms",
    f""", w as (with recursive r(start, node, depth) as (select id, id, 0 from n
      where kind = 'axiom' union select start, e.target, depth + 1 from r join e on e.source = r.node
      where e.relation in {SCORED}) select start, node, min(depth)::int as depth
      from r group by 1, 2) select * from w""",
    lambda n, e: graph.closure(_scored(e), n.where("kind = 'axiom'").select("id")),
)
on_graph(
    "neighbourhood",
    """, o as (select id from n where starts_with(host, 'volume-3/')), t as (select *
      from e where source in (select id from o) or target in (select id from o))
      select id, kind from n where id in (select id from o union select source
      from t union select target from t)""",
    lambda n, e: graph.neighbourhood(n, e, "volume-3")[0].select("id", "kind"),
)
on_graph(
    "volume_bundles",
    f""", v as (select id, split_part(host, '/', 1) as v from n) select a.v as tail, b.v as head, {', '.join(f"count(*) filter (relation = '{r}') as {r}" for r in G.SCORING)}
      from e join v a on e.source = a.id join v b on e.target = b.id where a.v <> b.v
      group by 1, 2""",
    lambda n, e: build.volume_bundles(n, e),
)


def _rebuilt(n: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph under other ids, with some parts' titles, some rigors and some relations changed."""
    anew = lambda c: F.concat(F.lit("x"), F.reverse(c))
    part = F.col("id").startswith("clm-p") & F.col("id").endswith("7")
    nodes = n.select("kind", anew("id").alias("id"), F.when(part, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), "host", F.when(F.col("kind") == "axiom", 0.5).otherwise(F.col("rigor")).alias("rigor"))
    return nodes, e.select(F.when(F.col("relation") == "demoted", "references").otherwise(F.col("relation")).alias("relation"), anew("source").alias("source"), anew("target").alias("target"), "bearing")


on_graph(
    "kb_modulo_ids",
    """, a as (select id, kind || '|' || coalesce(title, '') || '|' || coalesce(host, '') as key, rigor
      from n),
  b as (select id, kind || '|' || coalesce(case when id like 'clm-p%7' then title || '!' else title end, '') || '|' || coalesce(host, '') as key, case when kind = 'axiom' then 0.5 else rigor end as rigor
      from n),
  l as (select 'node' as part, key, '' as to_key, '' as relation, rigor as value
      from a union all select 'edge', s.key, t.key, relation, bearing from e join a s on e.source = s.id
      join a t on e.target = t.id),
  r as (select 'node' as part, key, '' as to_key, '' as relation, rigor as value
      from b union all select 'edge', s.key, t.key, case when relation = 'demoted' then 'references' else relation end, bearing
      from e join b s on e.source = s.id join b t on e.target = t.id),
  u as (select *, 1 as d from l union all select *, -1 from r), g as (select part, key, to_key, relation, value, sum(d) as d
      from u group by all having sum(d) <> 0)
  select part, key, to_key, relation, value, greatest(d, 0)::bigint as lost, greatest(-d, 0)::bigint as added
      from g""",
    lambda n, e: build.modulo_diff((n, e), _rebuilt(n, e)),
)
# integrity


def _broken(n: DataFrame, e: DataFrame) -> DataFrame:
    """The edges with faults: works to a claim that isn't there, some refutations twice, references demoted as lifts."""
    works = n.where("kind = 'work'").select(F.lit("supports").alias("relation"), F.lit(None).cast("string").alias("replaced_relation"), F.col("id").alias("source"), F.lit("clm-zzzzzz").alias("target"), F.lit("").alias("context"), F.lit(0.5).alias("bearing"), F.lit(False).alias("bearing_pending"), F.lit(False).alias("manually_scored"))
    return e.unionByName(works).unionByName(e.where("relation = 'refutes' and bearing = 0.5D")).unionByName(e.where("relation = 'references'").withColumn("bearing", F.lit(0.1)).withColumn("replaced_relation", F.lit("lifts")).withColumn("relation", F.lit("demoted")))


_BROKEN_SQL = """, b as (select * from e union all select 'supports', null, id, 'clm-zzzzzz', '', 0.5::double, false, false from n where kind = 'work' union all select * from e where relation = 'refutes' and bearing = 0.5::double
  union all select 'demoted', 'lifts', source, target, context, 0.1::double, bearing_pending, manually_scored from e where relation = 'references')"""
on_graph(
    "faults_dangling",
    _BROKEN_SQL + " select 'dangling' as \"check\", relation || ' ' || source || ' ' || target as subject, 'target ' || target as detail from b where target not in (select id from n)",
    lambda n, e: verify.dangling(n, _broken(n, e)),
)
on_graph(
    "faults_duplicate_edges",
    _BROKEN_SQL + " select 'duplicate edge' as \"check\", relation || ' ' || source || ' ' || target as subject, count(*)::varchar as detail from b group by relation, replaced_relation, source, target having count(*) > 1",
    lambda n, e: verify.duplicate_edges(_broken(n, e)),
)
on_graph(
    "faults_illegal_pairing",
    _BROKEN_SQL + """ select 'illegal pairing' as "check", relation || ' ' || source || ' ' || target as subject, s.kind || ' ' || t.kind as detail from b join n s on b.source = s.id join n t on b.target = t.id
  where (bearing is not null or bearing_pending) and not (t.kind in ('claim', 'analysis') and case case when relation = 'demoted' then replaced_relation else relation end when 'supports' then s.kind in ('claim', 'experiment') when 'founds' then s.kind in ('work', 'axiom') when 'lifts' then s.kind in ('analysis', 'experiment') when 'refutes' then s.kind in ('claim', 'analysis', 'experiment') else false end)""",
    lambda n, e: verify.illegal_pairs(n, _broken(n, e)),
)
on_graph(
    "faults_domains",
    """, fd as (select * replace (case when kind = 'work' then rigor + 1 else rigor end as rigor, case when kind = 'axiom' then upper(id) else id end as id)
      from n)
  select 'rigor outside [0, 1]' as "check", id as subject, rigor::varchar as detail
      from fd where rigor < 0 or rigor > 1 union all select 'bad id', id, kind
      from fd where not regexp_matches(id, '^(clm|exp|ana|wrk|axm)-[a-z0-9]{6}$')
  union all select 'bearing outside [0, 1]', relation || ' ' || source || ' ' || target, (-bearing)::varchar
      from e where relation = 'founds' and bearing > 0""",
    lambda n, e: verify.domains(n.withColumn("rigor", F.when(F.col("kind") == "work", F.col("rigor") + 1).otherwise(F.col("rigor"))).withColumn("id", F.when(F.col("kind") == "axiom", F.upper("id")).otherwise(F.col("id"))), e.withColumn("bearing", F.when((F.col("relation") == "founds"), -F.col("bearing")).otherwise(F.col("bearing")))),
)
on_graph(
    "judged_hash",
    "select id, sha256('9:statement' || strlen(title) || ':' || title) as judged_hash from n where kind = 'claim'",
    lambda n, e: n.where("kind = 'claim'").select("id", G.judged_hash(F.lit("statement"), F.col("title")).alias("judged_hash")),
)
on_graph(
    "dirty_items",
    """select id, sha256('9:statement' || strlen(title) || ':' || title) as hash
      from n where kind = 'claim' and not manually_scored and not (dependents % 2 = 0)""",
    lambda n, e: score.dirty(n.where("kind = 'claim'").select("id", F.col("title").alias("statement"), "manually_scored", F.when(F.col("dependents") % 2 == 0, G.judged_hash(F.lit("statement"), F.col("title"))).otherwise("0").alias("judged_hash")), "statement").select("id", "hash"),
)


on_graph(
    "volume_table",
    """, o as (select split_part(host, '/', 1) as v, id, kind from n where host is not null), u as (select source as id
      from e union select target from e),
  i as (select a.v, count(*) as k from e join o a on e.source = a.id join o b on e.target = b.id
      where a.v = b.v group by 1)
  select o.v as volume, count(*) filter (kind = 'claim') as claim, count(*) filter (kind = 'analysis') as analysis, count(*) filter (kind = 'experiment') as experiment, count(*) filter (o.id not in (select id
      from u)) as unattached, coalesce(max(k), 0) as "inner" from o left join i on o.v = i.v
      group by 1""",
    render.volume_table,
)
# text and build
_part = lambda p: p.select(F.concat(F.lit("clm-p"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("id"), F.col("p_brand").alias("document"), F.lit("parts").alias("paper"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("line"))
_P = "select 'clm-p' || lpad(p_partkey::varchar, 5, '0') as id, p_brand as document, p_partkey as seq, p_size as line from part"
on_tables(
    "proximity_topk",
    f"""with p as ({_P}) select a.id as source, row_number() over (partition by a.id
      order by (a.document <> b.document)::int, abs(a.seq - b.seq), b.seq)::int as rank, b.id as target
      from p a join p b on a.id <> b.id qualify rank <= 3""",
    lambda p: build.proximity(_part(p)),
    "part",
)
on_tables(
    "adjacent_links",
    f"""with p as ({_P}), l as (select id, lag(id) over (partition by document order by line, id) as before
      from p) select least(id, before) as a, greatest(id, before) as b from l
      where before is not null""",
    lambda p: build.adjacent_links(_part(p), _part(p).limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))),
    "part",
)
on_tables(
    "endcap_works",
    "select 'wrk-' || lpad(n_nationkey::varchar, 6, '0') as source, c_name as target from customer join nation on c_nationkey = n_nationkey",
    lambda c, n: build.endcap_works(c.select(F.col("c_name").alias("id")), c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("claim"), F.col("n_name").alias("key")), n.select(F.concat(F.lit("wrk-"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).alias("id"), F.col("n_name").alias("label"))),
    "customer",
    "nation",
)
_ALLOWED = {"R": ["lifts", "supports"], "A": ["refutes", "supports"], "N": ["lifts", "refutes", "supports"]}


def _provenances(lines: DataFrame) -> DataFrame:
    way = F.when(F.col("l_returnflag") == "R", F.array(*map(F.lit, _ALLOWED["R"]))).when(F.col("l_returnflag") == "A", F.array(*map(F.lit, _ALLOWED["A"]))).otherwise(F.array(*map(F.lit, _ALLOWED["N"])))
    return lines.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), way.alias("allowed"), F.col("l_linestatus").alias("harvest"))


on_tables(
    "offered_intersection",
    """select l_suppkey as source, l_partkey as target, string_agg(distinct l_linestatus, ','
      order by l_linestatus) as harvests,
  case when count(*) filter (l_returnflag = 'A') > 0 then '' else 'lifts,' end || case when count(*) filter (l_returnflag = 'R') > 0 then '' else 'refutes,' end || 'supports' as allowed
      from lineitem group by 1, 2""",
    lambda x: build.offered(_provenances(x)).select("source", "target", F.array_join("harvests", ",").alias("harvests"), F.array_join("allowed", ",").alias("allowed")),
    "lineitem",
)


def _answers(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_custkey").alias("culled"), (F.col("o_custkey") - F.col("o_orderkey") % 5 - 1).alias("into")).where("into >= 0")


def _culls(orders: DataFrame, customers: DataFrame) -> DataFrame:
    everyone = customers.select(F.col("c_custkey").alias("id"))
    return build.cull_targets(_answers(orders), everyone, everyone.withColumn("position", F.col("id")))


_T = "t as (select o_custkey as id, min(o_custkey - o_orderkey % 5 - 1) as into_ from orders where o_custkey - o_orderkey % 5 - 1 >= 0 group by 1)"
on_tables("cull_targets", f"with {_T} select id, into_ as into from t".replace(" as into from", ' as "into" from'), _culls, "orders", "customer")
_R = f"with recursive {_T}, r(id, pos) as (select id, into_ from t union all select r.id, t.into_ from r join t on r.pos = t.id)"
on_tables("cull_roots", f"{_R} select id, min(pos) as root from r group by 1", lambda o, c: build.cull_roots(_culls(o, c)), "orders", "customer")
on_tables(
    "cull_final",
    f"""{_R}, x as (select id, min(pos) as root from r group by 1) select x.id, x.root
      from x join t on x.id = t.id where t.into_ = x.root or x.id % 2 = 0""",
    lambda o, c: build.final_culls(t := star.settle(_culls(o, c)), r := build.cull_roots(t), r.where("id % 2 = 0")),
    "orders",
    "customer",
)
on_tables(
    "contracted_links",
    f"""{_R}, x as (select id, min(pos) as root from r group by 1), l as (select o_custkey as a, o_orderkey % 100 as b, case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end as h
      from orders),
  m as (select coalesce(xa.root, a) as a, coalesce(xb.root, b) as b, h
      from l left join x xa on a = xa.id left join x xb on b = xb.id) select least(a, b) as a, greatest(a, b) as b, ['marked', 'unmarked', 'adjacent'][min(h)] as harvest
      from m where a <> b group by 1, 2""",
    lambda o, c: build.contracted_links(o.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b"), F.when(F.col("o_orderstatus") == "F", "adjacent").when(F.col("o_orderstatus") == "O", "unmarked").otherwise("marked").alias("harvest")), build.cull_roots(_culls(o, c))),
    "orders",
    "customer",
)
on_tables(
    "multiset_diff",
    """select o_orderpriority, greatest(d, 0)::bigint as lost, greatest(-d, 0)::bigint as added
      from (select o_orderpriority, count(*) filter (o_orderstatus = 'F') - count(*) filter (o_orderstatus = 'O') as d
      from orders group by 1) where d <> 0""",
    lambda o: build.multiset_diff(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_orderpriority"]),
    "orders",
)
on_tables(
    "tfidf_shortlist",
    r"""with t as (select doc_id::varchar as id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda y: lower(y)), lambda y: length(y) > 2 and not regexp_full_match(y, '\p{Nd}+') and not list_contains(['%s'], y)) as ws
      from documents),
  f as (select id, term, count(*) as tf from (select id, unnest(ws) as term
      from t) group by all), d as (select term, count(*) as df from f group by 1),
  r as (select id, term, (1 + ln(tf)) * (ln((1.0 + (select count(*) from t)) / (1.0 + df)) + 1.0) as w
      from f join d using (term)), v as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w
      from r),
  c as (select a.id as source, b.id as target, round(sum(a.w * b.w), 12) as cosine
      from v a join v b on a.term = b.term and a.id <> b.id group by all),
  p as (select a.id as source, b.id as target, coalesce(cosine, 0) as cosine
      from t a join t b on a.id <> b.id left join c on c.source = a.id and c.target = b.id)
  select source, row_number() over (partition by source order by cosine desc, target)::int as rank, target, round(cosine, 9) as cosine
      from p qualify rank <= 2""" % "', '".join(sorted(T.STOPWORDS)),
    lambda b: build.tfidf_shortlist(b.select(F.col("doc_id").cast("string").alias("id"), "text"), 2).withColumn("cosine", F.round("cosine", 9)),
    "documents",
)
on_tables(
    "dead_page_links",
    """with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href
      from pages), u as (select distinct regexp_extract(url, '^https?://[^/]+(/.*)$', 1) as p
      from pages) select page_id, href, count(*) as n from l where href not in (select p
      from u) group by 1, 2""",
    lambda p: p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).join(p.select(F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1).alias("_p")).distinct(), F.col("href") == F.col("_p"), "left_anti").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n")),
    "pages",
)
_ev = lambda e: e.select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), "event_type")
on_tables(
    "section_asof",
    """select user_id as path, event_id as line, event_id::varchar as id, coalesce(last_value(case when event_type = 'signup' then event_id::varchar end ignore nulls) over (partition by user_id
      order by event_id), '') as anchor from events qualify event_type = 'purchase'""",
    lambda e: build.hosted_under(_ev(e).where("event_type = 'purchase'").withColumn("id", F.col("line").cast("string")), _ev(e).where("event_type = 'signup'").withColumn("anchor", F.col("line").cast("string"))),
    "events",
)
on_tables(
    "interval_in_block",
    "select event_id, n_nationkey from events join nation on event_id >= n_nationkey * 37 and event_id < n_nationkey * 37 + 50",
    lambda e, n: build.inside(e.select(F.lit("all").alias("path"), F.col("event_id").alias("line"), "event_id"), n.select(F.lit("all").alias("path"), (F.col("n_nationkey") * 37).alias("start"), (F.col("n_nationkey") * 37 + 50).alias("stop"), "n_nationkey")).select("event_id", "n_nationkey"),
    "events",
    "nation",
)
on_tables(
    "excerpts",
    """select n_name as path, upto::bigint as upto from (select n_name, sum(length(n_name)) over (order by n_nationkey) as upto
      from nation) where upto <= 100""",
    lambda n: build.excerpts(n.select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("path"), F.col("n_name").alias("text")), 100).select("path", "upto"),
    "nation",
)


# scoring and ledgers: an event is an attempt line of its user
def _lines(e: DataFrame, tables=score.FAULTS) -> DataFrame:
    faults = F.concat(F.array_repeat(F.lit("flt-overreach"), (F.col("event_id") % 9).cast("int")), F.when(F.col("event_id") % 50 == 0, F.array(F.lit("flt-pending"))).otherwise(F.array().cast("array<string>")))
    return e.select(F.col("user_id").alias("item"), F.col("event_id").alias("ord"), F.col("event_type").alias("status"), faults.alias("faults"), F.lit("statement").alias("vocabulary")).withColumn("value", score.price(F.col("faults"), F.col("vocabulary"), tables))


_PRICE = "case when event_id % 50 = 0 then null else greatest(0, 100 - {0} * (event_id % 9)) / 100.0::double end"
on_tables("price_faults", f"select event_id as ord, {_PRICE.format(15)} as value from events", lambda e: _lines(e).select("ord", "value"), "events")
on_tables(
    "ledger_last_state",
    f"""select user_id as item, event_id as ord, event_type as status, {_PRICE.format(15)} as value
      from events qualify row_number() over (partition by user_id order by event_id desc) = 1""",
    lambda e: score.last_state(_lines(e)).select("item", "ord", "status", "value"),
    "events",
)
on_tables(
    "ledger_fold",
    "select event_id from events where event_type <> 'error'",
    lambda e: score.fold_ledger(e.where("event_type = 'error'").select("event_id", "ts"), e.select("event_id", "ts"), ("event_id", "ts")).select("event_id"),
    "events",
)
on_tables(
    "reprice_moved",
    f"""select item, value, new from (select user_id as item, {_PRICE.format(15)} as value, {_PRICE.format(20)} as new
      from events qualify row_number() over (partition by user_id order by event_id desc) = 1)
      where value is distinct from new""",
    lambda e: score.repriced(_lines(e), {"statement": {**score.FAULTS["statement"], "flt-overreach": 20}}),
    "events",
)
on_tables(
    "replay_agreement",
    """with a as (select user_id, max(value) as v from events where event_type = 'click'
      group by 1), b as (select user_id, max(value) as v from events where event_type = 'purchase'
      group by 1) select coalesce(a.user_id, b.user_id) as item, a.v as recorded, b.v as replayed, a.v is not distinct
      from b.v as agrees from a full join b on a.user_id = b.user_id""",
    lambda e: score.replay_agreement(*[e.where(F.col("event_type") == t).groupBy(F.col("user_id").alias("item")).agg(F.max("value").alias("value")) for t in ("click", "purchase")]),
    "events",
)
on_tables(
    "progress_sessions",
    """select event_id as ord, count(*) filter (event_type = 'signup') over (partition by user_id
      order by event_id)::bigint as session from events""",
    lambda e: score.sessions(e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "signup", "run").otherwise(F.col("event_type")).alias("kind"))).select("ord", F.col("session").cast("long")),
    "events",
)
on_tables(
    "retention",
    """select event_type as kind, event_id as name from events qualify row_number() over (partition by event_type
      order by ts desc, event_id) <= 5""",
    lambda e: score.retained(e.select(F.col("event_type").alias("kind"), F.col("ts").alias("started"), F.col("event_id").alias("name")), 5).select("kind", "name"),
    "events",
)
on_tables(
    "ask_totals",
    """select event_type as outcome, count(*) as n, sum(event_id)::bigint as tokens, count(*) filter (r > 1) as warm
      from (select *, row_number() over (partition by user_id order by event_id) as r
      from events) group by 1""",
    lambda e: score.ask_totals(e.select(F.col("user_id").alias("group"), F.col("event_id").alias("ord"), F.col("event_type").alias("outcome"), F.col("event_id").alias("tokens"))),
    "events",
)


def _streamed(name: str, rows: Callable[[DataFrame], DataFrame], keys: list[str], schema: str):
    """A streaming aggregate over the events' file in update mode, run until all files are read: each batch's changed rows are written once, and the last of each key counts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir}/events.parquet"
        star.settle(spark.range(1))  # sets the shared folder
        root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
        stream = rows(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet"))
        keep = lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/out/{batch:012d}")
        out = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
        out.awaitTermination()
        held = spark.read.schema(f"{schema}, _batch int").parquet(f"{root}/out/*")
        rest = [c for c in held.columns if c not in (*keys, "_batch")]
        return held.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")

    QUERIES[name] = run


_streamed("stream_event_counts", lambda e: ledger.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz")), ["start", "event_type"], "start timestamp_ntz, event_type string, n long")
ORACLES["stream_event_counts"] = "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2"
_streamed("stream_last_state", lambda e: ledger.last_states(e.select(F.col("user_id").alias("item"), F.col("event_type").alias("status"), "value", F.col("event_id").alias("ended"), F.lit("").alias("digest"))), ["item"], "item long, status string, value double")
ORACLES["stream_last_state"] = "select user_id as item, event_type as status, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1"


on_tables(
    "reference_routes",
    """select o_orderkey as reference, case when o_orderkey % 4 = 0 then 'c' || (o_custkey % 50)::varchar when o_orderkey % 4 = 1 then 'n' || (o_custkey % 25)::varchar end as target, case o_orderkey % 4 when 0 then 'identifier' when 1 then 'block' end as route
      from orders""",
    lambda o, n: build.routed(o.select(F.col("o_orderkey").alias("reference"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("c"), F.col("o_custkey") % 50)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("n"), F.col("o_custkey") % 25)).otherwise("none").alias("label"), F.lit("d").alias("document")), o.select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("label")).withColumn("id", F.col("label")), n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("label")).withColumn("id", F.col("label")), n.limit(0).select(F.col("n_name").alias("label"), F.col("n_name").alias("id")), n.select(F.lit("d").alias("document"), F.col("n_name").alias("id"))),
    "orders",
    "nation",
)
on_tables(
    "compensated_sum",
    "select user_id, round(sum(value::decimal(38, 12))::double, 6) as total, count(*) as n from events group by 1",
    lambda e: build.compensated_sums(e, "user_id", "event_id", "value").select("user_id", F.round("total", 6).alias("total"), "n"),
    "events",
)


