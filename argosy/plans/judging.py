"""Queries on judgements: replies, prices, digests, runs, numbers as records spell them. Events and orders stand for attempts and asks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.operators import asks, build, score
from argosy.plans.registry import on_graph, on_tables

# Replies by the event's number: charges, none, and refusals; the closed text is two passages, of three lines and one.
_REPLIES = ["flt-overreach: 1\nFLT-OVERREACH: 3", "none", "none\nflt-overreach: 1", "flt-overreach: 1-2\nflt-overreach: 2-3", "flt-overreach: 3-4", "", "0.7", "flt-overreach", "flt-transfer: 1", "flt-overreach: 9", "flt-overreach: 2-1", "flt-equivocation: 1-3\nflt-overreach: 4"]
_FAULTS = ["flt-overreach,flt-overreach", "", "", "", "", "", "", "", "", "", "", "flt-equivocation,flt-overreach"]
_REFUSALS = ["", "", "none-beside-charges", "overlapping-ranges", "range-crosses-parts", "empty-reply", "bare-number", "id-without-line", "id-not-offered", "line-not-shown", "range-backwards", ""]
_VALUES = ["0.7", "1.0", *["null"] * 9, "0.7"]


def _case(of: list[str], quote: bool = True) -> str:
    return f"case event_id % {len(of)} " + " ".join(f"when {i} then " + (f"'{x}'" if quote else x) for i, x in enumerate(of)) + " end"


def _asked(e: DataFrame) -> DataFrame:
    texts = F.array(F.lit("One\ntwo\nthree"), F.lit("Four"))
    return e.select(F.col("event_id").alias("item"), F.lit("statement").alias("vocabulary"), F.array(F.lit("a"), F.lit("b")).alias("ends"), texts.alias("texts"))


def _judge(batch: pd.DataFrame) -> pd.Series:
    return batch["item"].map(lambda i: None if i % 97 == 0 else _REPLIES[i % len(_REPLIES)])


on_tables(
    "answer_parse",
    f"select event_id as item, {_case(_FAULTS)} as faults, {_case(_REFUSALS)} as refusal, {_case(_VALUES, False)}::double as value from events",
    lambda e: score.parsed(_asked(e).withColumn("reply", F.element_at(F.array(*map(F.lit, _REPLIES)), (F.col("item") % len(_REPLIES) + 1).cast("int")))).select("item", F.array_join("faults", ",").alias("faults"), "refusal", "value"),
    "events",
)
on_tables(
    "scoring_run",
    f"""select event_id as item, case when event_id % 97 = 0 then 'failed' when {_case(_REFUSALS)} <> '' then 'refused' else 'scored' end as status, case when event_id % 97 = 0 then '' else {_case(_REFUSALS)} end as refusal,
  case when event_id % 97 <> 0 then {_case(_VALUES, False)}::double end as value
      from events""",
    lambda e: asks.scoring_run(_asked(e), _judge).select("item", "status", "refusal", "value"),
    "events",
)
on_tables(
    "decided",
    """select event_id as item, case when event_id % 7 = 0 then null when event_id % 3 = 0 then case when value > 50 then 'B' else 'A' end when event_id % 3 = 1 then 'A' else 'C' end as letter
      from events""",
    lambda e: build.decided(e.select(
        F.col("event_id").alias("item"), F.when(F.col("event_id") % 7 == 0, "AB").when(F.col("event_id") % 3 == 2, " C ").otherwise("").alias("text"),
        F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 3 == 0, F.create_map(F.lit("A"), F.lit(50.0), F.lit("B"), F.col("value"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("C"), F.lit(0.5), F.lit("A"), F.lit(0.5))).alias("confidence"),
        F.array(*map(F.lit, "ABC")).alias("offered"),
    )),
    "events",
)
_SPELLED = "coalesce(" + ", ".join(f"case when abs(format('{{:.{d}f}}', x)::double - x) < 1e-9::double then format('{{:.{d}f}}', x) end" for d in range(4, 16)) + ")"
on_tables(
    "record_numbers",
    f"""with v as (select l_orderkey, l_linenumber, l_discount * l_quantity / 7.0::double as x
      from lineitem) select l_orderkey, l_linenumber, regexp_replace(regexp_replace({_SPELLED}, '0+$', ''), '\\.$', '') as text
      from v""",
    lambda x: x.select("l_orderkey", "l_linenumber", T.udf(M.record_number, "string")(F.col("l_discount") * F.col("l_quantity") / F.lit(7.0)).alias("text")),
    "lineitem",
)
_TEMPLATE = "Does {{ source }} support {{ target }}? Answer for {{ source }} alone."
on_graph(
    "template_render",
    "select source, target, 'Does ' || source || ' support ' || target || '? Answer for ' || source || ' alone.' as ask from e where relation = 'supports'",
    lambda n, e: e.where("relation = 'supports'").select("source", "target", asks.render_column(_TEMPLATE, {"source": F.col("source"), "target": F.col("target")}).alias("ask")),
)
_L = "strlen({0}) || ':' || {0}"
on_graph(
    "ask_digest",
    f"""select source, target, sha256({_L.format(chr(39) + 'choice' + chr(39))} || {_L.format('source')} || {_L.format(chr(39) + 'A' + chr(39))} || '1:A' || {_L.format('target')} || '1:B' || {_L.format('context')} || {_L.format(chr(39) + 'state' + chr(39))}) as digest
      from e where relation = 'supports'""",
    lambda n, e: e.where("relation = 'supports'").select("source", "target", asks.ask_digest(F.lit("choice"), F.col("source"), F.lit("A"), F.create_map(F.lit("B"), F.col("context"), F.lit("A"), F.col("target")), F.lit("state")).alias("digest")),
)
on_tables(
    "shared_inputs",
    """with i as (select o_custkey as grp, o_orderkey as item, unnest(['status', 'prio', 'cust']) as key, unnest([o_orderstatus, o_orderpriority, o_custkey::varchar]) as value
      from orders), n as (select o_custkey as grp, count(*) as n from orders group by 1)
  select grp, item, key, value, count(*) over (partition by grp, key, value) = n as shared
      from i join n using (grp)""",
    lambda o: asks.shared_inputs(o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("item"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("prio"), F.col("o_orderpriority"), F.lit("cust"), F.col("o_custkey").cast("string")).alias("inputs")), "grp", "item", "inputs"),
    "orders",
)
on_tables(
    "timestamps",
    "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as started, date_trunc('second', ts) = ts as whole from events",
    lambda e: e.select("event_id", asks.timestamp_text(F.col("ts")).alias("started"), "ts").select("event_id", "started", (asks.started_at(F.col("started")).cast("timestamp_ntz") == F.col("ts").cast("timestamp_ntz")).alias("whole")),
    "events",
)
on_tables(
    "run_counts",
    """select event_type as status, count(*) as n from (select * from events qualify row_number() over (partition by user_id
      order by event_id desc) = 1) group by 1""",
    lambda e: asks.run_counts(e.select(F.col("user_id").alias("item"), F.col("event_id").alias("ord"), F.col("event_type").alias("status"))),
    "events",
)
_KIND = "case event_type when 'purchase' then 'done' when 'error' then 'failed' else event_type end"
on_tables(
    "run_state",
    f"""select user_id as stream, case when k in ('done', 'failed') then k else 'running' end as state, k in ('done', 'failed') as ended
      from (select user_id, {_KIND} as k from events qualify row_number() over (partition by user_id
      order by event_id desc) = 1)""",
    lambda e: asks.run_state(e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), F.expr(_KIND).alias("kind"))),
    "events",
)


def _run(e: DataFrame, step: int) -> DataFrame:
    faults = F.array_repeat(F.lit("flt-overreach"), (F.floor(F.col("event_id") / step) % 3).cast("int"))
    rows = e.select(F.col("event_id").alias("item"), F.lit("statement").alias("vocabulary"), F.col("event_type").alias("passage"), F.when(F.col("event_id") % (5 * step) == 0, "refused").otherwise("scored").alias("status"), faults.alias("faults"))
    return rows.withColumn("value", score.price(F.col("faults"), F.col("vocabulary")))


on_tables(
    "replay_comparison",
    """with a as (select event_type as passage, event_id % 3 as f, event_id % 5 = 0 as r, (event_id // 2) % 3 as f2, event_id % 10 = 0 as r2
      from events)
  select 'statement' as vocabulary, passage, count(*) as both, count(*) filter (f = f2) as same_value, count(*) filter (f = f2) as same_faults, count(*) filter (r = r2) as same_status
      from a group by 1, 2""",
    lambda e: asks.replayed(_run(e, 1), _run(e, 2)),
    "events",
)
on_graph(
    "landed_values",
    """select id, case when kind = 'claim' and not manually_scored and dependents % 3 = 0 then 0.25 else rigor end as rigor, case when kind = 'claim' and not manually_scored and dependents % 3 = 0 then sha256('9:statement' || strlen(title) || ':' || title) end as judged_hash, case when kind = 'claim' and not manually_scored and dependents % 3 = 0 then false else manually_scored end as manually_scored
      from n""",
    lambda n, e: asks.landed(
        n.withColumn("judged_hash", F.lit(None).cast("string")), n.where("kind = 'claim'").select(F.col("id").alias("item"), F.when(F.col("dependents") % 3 == 0, "scored").otherwise("refused").alias("status"), F.lit(0.25).alias("value")),
        n.select("id", asks.digest(F.lit("statement"), F.col("title")).alias("hash")),
    ).select("id", "rigor", "judged_hash", "manually_scored"),
)
# An edge's item is its ends and relation; every third is refused.
on_graph(
    "landed_bearings",
    """select relation, source, target, case when hit then 0.75::double else bearing end as bearing, case when hit then false else bearing_pending end as bearing_pending, case when hit then sha256('7:bearing' || strlen(source || target) || ':' || source || target) end as judged_hash
      from (select *, relation in ('supports', 'lifts', 'refutes') and not coalesce(manually_scored, false) and (length(context) + ascii(right(source, 1)) + ascii(right(target, 1))) % 3 <> 0 as hit from e)""",
    lambda n, e: asks.landed_edges(
        e.withColumn("judged_hash", F.lit(None).cast("string")),
        e.where("relation <> 'founds'").select("relation", "source", "target", F.when((F.length("context") + F.ascii(F.right("source", F.lit(1))) + F.ascii(F.right("target", F.lit(1)))) % 3 == 0, "refused").otherwise("scored").alias("status"), F.lit(0.75).alias("value"), asks.digest(F.lit("bearing"), F.concat("source", "target")).alias("hash")),
    ).select("relation", "source", "target", "bearing", "bearing_pending", "judged_hash"),
)
