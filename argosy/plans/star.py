"""The star schema as a claim graph: deterministic views that give every graph query real rows.

The SQL below runs in Spark and in DuckDB alike; `{table}` stands for a table. Ids keep the six-character grammar while keys
have five digits (claims) or six (others), and grow with the key beyond.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _id(prefix: str, key: str, width: int) -> str:
    return f"('{prefix}' || case when length(cast({key} as string)) < {width} then lpad(cast({key} as string), {width}, '0') else cast({key} as string) end)"


AXM, WRK, CLS, CLC, CLP = (lambda k: _id("axm-", k, 6)), (lambda k: _id("wrk-", k, 6)), (lambda k: _id("clm-s", k, 5)), (lambda k: _id("clm-c", k, 5)), (lambda k: _id("clm-p", k, 5))
ANA, EXP = (lambda k: _id("ana-", k, 6)), (lambda k: _id("exp-", k, 6))

_NODE = "select '{kind}' as kind, {id} as id, {title} as title, {label} as label, {status} as status, {rigor} as rigor, {manual} as manually_scored, {host} as host from {{{table}}}"
_NO_TEXT, _NO_BOOL = "cast(null as string)", "cast(null as boolean)"


def _node(table: str, kind: str, id: str, title: str, rigor: str, label: str = _NO_TEXT, status: str = _NO_TEXT, manual: str = _NO_BOOL, host: str = _NO_TEXT) -> str:
    return _NODE.format(table=table, kind=kind, id=id, title=title, label=label, status=status, rigor=f"cast({rigor} as double)", manual=manual, host=host)


def _ratio(expr: str, of: int) -> str:
    return f"cast({expr} as double) / cast({of} as double)"


NODES = "\nunion all ".join([
    _node("region", "axiom", AXM("r_regionkey"), "r_name", "1", label="r_name"),
    _node("nation", "work", WRK("n_nationkey"), "n_name", f"case when n_nationkey % 8 = 0 then null else {_ratio('(n_nationkey * 7) % 20 + 1', 20)} end", label="n_name"),
    _node("supplier", "claim", CLS("s_suppkey"), "s_name", _ratio("(s_suppkey * 13) % 20 + 1", 20), manual="s_suppkey % 4 = 0", host="('volume-' || cast(s_nationkey as string) || '/suppliers.md')"),
    _node("customer", "claim", CLC("c_custkey"), "c_name", f"case when c_custkey % 11 = 0 then null else {_ratio('(c_custkey * 17) % 100 + 1', 100)} end", manual="c_custkey % 6 = 0", host="('volume-' || cast(c_nationkey as string) || '/customers.md')"),
    _node("part", "claim", CLP("p_partkey"), "p_name", _ratio("p_size", 50), manual="false", host="('parts/' || replace(p_brand, '#', '-') || '.md')"),
    _node("orders", "analysis", ANA("o_orderkey"), "o_orderpriority", f"case when o_orderkey % 13 = 0 then null else {_ratio('(o_orderkey * 19) % 100 + 1', 100)} end", manual="o_orderkey % 5 = 0", host="('orders/' || o_orderpriority || '.md')"),
    _node("events", "experiment", EXP("event_id"), "event_type", "least(value / cast(100 as double), cast(1 as double))", status="case when event_type in ('click', 'purchase') then 'run' else 'planned' end", manual="false", host="('events/' || event_type || '.md')"),
])

_EDGE = "select '{relation}' as relation, {replaced} as replaced_relation, {source} as source, {target} as target, {context} as context, cast({bearing} as double) as bearing, {pending} as bearing_pending, {manual} as manually_scored from {origin}"


def _edge(relation: str, source: str, target: str, origin: str, bearing: str = "null", pending: str = "false", manual: str = "false", replaced: str = _NO_TEXT, context: str = "''") -> str:
    return _EDGE.format(relation=relation, source=source, target=target, origin=origin, bearing=bearing, pending=pending, manual=manual, replaced=replaced, context=context)


_LAST_PART = "(select p_partkey, lag(p_partkey) over (partition by {by} order by p_partkey) as before from {{part}})"
EDGES = "\nunion all ".join([
    _edge("founds", AXM("n_regionkey"), CLS("s_suppkey"), "{supplier} join {nation} on s_nationkey = n_nationkey", bearing="1"),
    _edge("founds", WRK("s_nationkey"), CLS("s_suppkey"), "{supplier}", bearing=_ratio("s_suppkey % 10 + 1", 10)),
    _edge("founds", WRK("c_nationkey"), CLC("c_custkey"), "{customer}", bearing="case when c_custkey % 7 = 0 then null else 1 end", pending="c_custkey % 7 = 0"),
    _edge("supports", CLS("l_suppkey"), CLP("l_partkey"), "(select l_suppkey, l_partkey, min(l_discount) as low from {lineitem} group by l_suppkey, l_partkey) pairs",
          bearing="case when (l_suppkey + l_partkey) % 17 = 0 then null else cast(1 as double) - low end", pending="(l_suppkey + l_partkey) % 17 = 0", manual="l_partkey % 3 = 0", context="('line of ' || cast(l_suppkey as string))"),
    _edge("lifts", ANA("l_orderkey"), CLP("l_partkey"), "(select l_orderkey, l_partkey, max(l_discount) as high from {lineitem} where l_linenumber = 1 group by l_orderkey, l_partkey) firsts", bearing="least(high * cast(5 as double), cast(1 as double))"),
    _edge("lifts", EXP("event_id"), CLC("user_id"), "{events}", bearing=_ratio("event_id % 9 + 1", 10)),
    _edge("refutes", CLC("o_custkey"), ANA("o_orderkey"), "(select o_custkey, o_orderkey from {orders} where o_orderstatus = 'F') refuted", bearing=_ratio("o_orderkey % 5 + 1", 10), manual="o_orderkey % 4 = 0"),
    _edge("references", CLP("p_partkey"), CLP("before"), f"{_LAST_PART.format(by='p_brand')} chain where before is not null", pending="cast(null as boolean)", manual=_NO_BOOL),
    _edge("demoted", CLP("p_partkey"), CLP("before"), f"{_LAST_PART.format(by='p_type')} chain where before is not null", bearing=_ratio("p_partkey % 10 + 1", 10), replaced="'supports'"),
])


#: A Markdown document for each part, in a tree of ten children a node: an up-link, prose that names ids and results by hand, a
#: citation of the next part, code, repeated headings, statement markers and a child list; every fault that `verify` looks for is
#: planted by the key.
DOCUMENTS = f"""select k.p_partkey as k, 'parts/p' || cast(k.p_partkey as string) || '.md' as path,
case when k.p_partkey = 0 then 'Entry.' when k.p_partkey % 29 = 0 then '[up](p0.md)' else '[up](p' || cast(cast(floor((k.p_partkey - 1) / 10) as bigint) as string) || '.md)' end || chr(10) || chr(10) ||
'# Part ' || cast(k.p_partkey % 7 as string) || chr(10) || chr(10) ||
'Lemmas 2.1 and 2.' || cast(k.p_partkey % 5 as string) || ' say that ' || case when k.p_partkey % 5 = 0 then 'clm-qqqqqq' else {CLS('(k.p_partkey % 10)')} end || ' and `clm-zzzzzz` hold.' || chr(10) || chr(10) ||
'See [next](' || case when k.p_partkey % 17 = 0 then 'q' else 'p' end || cast(k.p_partkey + 1 as string) || '.md#' || case when k.p_partkey % 19 = 0 then 'nowhere' else 'part-' || cast((k.p_partkey + 1) % 7 as string) end || ' "' || {CLP('(k.p_partkey + 1)')} || '").' || chr(10) || chr(10) ||
'```' || chr(10) || 'clm-nocode and [gone](gone.md)' || chr(10) || '```' || chr(10) || chr(10) || '## Use' || chr(10) || chr(10) || '## Use' || chr(10) || chr(10) ||
'Statement ' || cast(k.p_partkey as string) || '. Its size is ' || cast(k.p_size as string) || '.' || case when k.p_partkey % 13 = 0 then '' else ' <!-- node-id: ' || {CLP('k.p_partkey')} || ' -->' end || chr(10) || chr(10) ||
case when k.p_partkey % 11 = 0 then '> Again ' || cast(k.p_partkey as string) || '. <!-- node-id: ' || {CLP('k.p_partkey')} || ' -->' else 'Nothing more.' end || chr(10) || chr(10) ||
concat_ws(chr(10), {', '.join(f"case when 10 * k.p_partkey + {j} < n.n and (10 * k.p_partkey + {j}) % 31 <> 0 then '- [child](p' || cast(10 * k.p_partkey + {j} as string) || '.md)' end" for j in range(1, 11))}) as text
from {{part}} k cross join (select count(*) as n from {{part}}) n"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, path, text of the star's documents."""
    return spark.sql(DOCUMENTS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


class Snapshot(NamedTuple):
    """A knowledge base as queries read it: nodes with strength and dependents, and edges."""

    nodes: DataFrame
    edges: DataFrame


def raw(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The records, without anything derived."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return Snapshot(spark.sql(NODES, **tables), spark.sql(EDGES, **tables))


_HELD: dict[tuple[str, str], Snapshot] = {}


def _folder(df: DataFrame) -> str:
    """spark.checkpoint.dir's folder for this application; a local run without one gets its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="argosy-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Computes `df` once and cuts its lineage by a checkpoint in spark.checkpoint.dir: for the rounds of loops."""
    _folder(df)
    return df.checkpoint(eager=True)


#: Of every stored table the application, a weak reference to its files in the JVM, their file system and their folder.
_STORED: list[tuple] = []
#: Bytes stored since garbage was collected, and how many start a collection.
_FRESH, COLLECT = [0], 64 << 20
#: How many times the size of its files a stored table takes in memory, about: joins would else send large ones to the driver as small.
EXPANDS = 10


def stored(df: DataFrame) -> DataFrame:
    """`settle` for large tables: compressed Parquet in spark.checkpoint.dir, a fraction of a checkpoint's rows, of which later steps read the columns they need.

    Files are deleted when no plan refers to them any more. Garbage is collected after every `COLLECT` bytes, so that neither these files nor those of
    finished shuffles stay longer than the steps that read them.
    """
    if len({c.lower() for c in df.columns}) < max(1, len(df.columns)) or "void" in df._jdf.schema().catalogString():
        return settle(df)  # what Parquet doesn't hold
    conf, key = df.sparkSession.conf, "spark.sql.sources.fileCompressionFactor"
    if float(conf.get(key)) < EXPANDS:
        conf.set(key, EXPANDS)
    context = df.sparkSession.sparkContext
    folder = f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    _sweep(context)  # what the steps since the last call have left
    df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    _STORED.append((context.applicationId, context._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location()), files, path))
    _FRESH[0] += files.getContentSummary(path).getLength()
    if _FRESH[0] > COLLECT:
        _sweep(context)
        _FRESH[0] = 0
    return out


def _sweep(context) -> None:
    """Deletes the files of stored tables that are out of use, after a collection of garbage if enough was stored."""
    if _FRESH[0] > COLLECT:
        gc.collect()  # plans that Python holds
        context._jvm.System.gc()
    own = [x for x in _STORED if x[0] == context.applicationId]  # an application before this one is gone, with its JVM
    for x in (gone := [x for x in own if x[1].get() is None]):
        x[2].delete(x[3], True)
    _STORED[:] = [x for x in own if x not in gone]


def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The derived view of a folder's tables, made once for an application: a knowledge base's records don't change under it."""
    from argosy.operators.strength import derive

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        _HELD.clear()
        found = raw(spark, sf_dir)
        edges = stored(found.edges)
        _HELD[key] = Snapshot(stored(derive(found.nodes, edges)), edges)
    return _HELD[key]


def records(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The records for queries that need nothing derived: the snapshot, if one is held, else the tables as they are read."""
    return _HELD.get((spark.sparkContext.applicationId, sf_dir)) or raw(spark, sf_dir)


def participants(nodes: DataFrame) -> DataFrame:
    """Terminal sources of the walk: axioms, works and run experiments."""
    return nodes.where(F.col("kind").isin("axiom", "work") | ((F.col("kind") == "experiment") & (F.col("status") == "run")))
