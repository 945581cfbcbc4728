"""Queries on older forms: register lines, markers, arguments and citations, from texts that the star's keys spell out."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosy.functions import text as T
from argosy.operators import derive, edits, ids, migrate, rename
from argosy.plans.registry import on_docs, on_tables
from argosy.plans.star import CLP, CLS

_ID = CLS("s_suppkey")
_PAGE = (
    f"'# Register' || chr(10) || 'lead' || chr(10) || '## ' || s_name || chr(10) || case when s_suppkey % 5 = 0 then '' else '<!-- node-id: ' || {_ID} || ' -->' end || chr(10) || '- rigor: ' || cast(s_suppkey % 10 as string) || chr(10) || '- rationale: why' || chr(10) || 'more of it' || chr(10) || chr(10) || "
    "case when s_suppkey % 3 = 0 then 'a stray line' else '  indented' end || chr(10) || '### Strength' || chr(10)"
)
on_tables(
    "register_lines",
    f"""select 'r' || s_suppkey as path, unnest([5, 6, 9])::int as line, {_ID} as entry, unnest(['rigor', 'rationale', null]) as field, unnest([(s_suppkey % 10)::varchar, 'why', 'a stray line']) as value
      from supplier where s_suppkey % 5 <> 0 and s_suppkey % 3 = 0
  union all select 'r' || s_suppkey, unnest([5, 6])::int, {_ID}, unnest(['rigor', 'rationale']), unnest([(s_suppkey % 10)::varchar, 'why'])
      from supplier where s_suppkey % 5 <> 0 and s_suppkey % 3 <> 0""",
    lambda s: migrate.register_lines(s.selectExpr("'r' || s_suppkey as path", f"{_PAGE} as text")),
    "supplier",
)
_OLD = f"'Claim.  <!-- old-id: ' || {_ID} || ', ' || {CLS('(s_suppkey + 1)')} || ' -->' || chr(10) || '<!-- old-id: ana-' || lpad(cast(s_suppkey as string), 6, '0') || ' -->' || chr(10) || 'end'"
on_tables(
    "one_marker_each",
    f"""select 'r' || s_suppkey as path, 'Claim.<!-- node-id: ' || {_ID} || ' --><!-- node-id: ' || {CLS('(s_suppkey + 1)')} || ' -->' || case when s_suppkey % 2 = 0 then '' else chr(10) end || '<!-- node-id: ana-' || lpad(s_suppkey::varchar, 6, '0') || ' -->' || chr(10) || 'end' as text
      from supplier""",
    lambda s: migrate.one_marker_each(s.selectExpr("'r' || s_suppkey as path", f"{_OLD} as text"), s.where("s_suppkey % 2 = 0").selectExpr("'ana-' || lpad(cast(s_suppkey as string), 6, '0') as analysis", f"{CLS('(s_suppkey + 1)')} as claim"), "old-id"),
    "supplier",
)
on_tables(
    "split_arguments",
    f"select {ids.derived_sql('ana', 'c_custkey')} as id, c_custkey as claim, c_name as title, c_mktsegment as text from customer where c_custkey % 4 <> 0",
    lambda c: migrate.split_arguments((e := c.selectExpr("'a' as path", "c_custkey as line", "c_custkey as id", "c_name as title", "case when c_custkey % 4 <> 0 then c_mktsegment else ' ' end as argument")).unionByName(e.selectExpr("'b' as path", "line", "id", "'later' as title", "'x' as argument")))[1],
    "customer",
)
# The first derivations of every tenth key are taken already.
on_tables(
    "minted_ids",
    f"select o_orderkey::varchar as seed, case when o_orderkey % 10 = 0 then {ids.derived_sql('ana', 'o_orderkey', '1')} else {ids.derived_sql('ana', 'o_orderkey')} end as id from orders",
    lambda o: ids.mint((seeds := o.select(F.col("o_orderkey").cast("string").alias("seed"))).unionByName(seeds), "ana", o.where("o_orderkey % 10 = 0").select(ids.derived("ana", F.col("o_orderkey").cast("string")).alias("id"))),
    "orders",
)


def _bare(d):
    """The documents with links into the next one's second section, without titles."""
    return d.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"#(?:part-\d|nowhere)", "#use-1"), ' "clm-[a-z0-9]+"', ""))


on_docs(
    "statement_citations",
    r"""select path, md5(regexp_replace(regexp_replace(regexp_replace(text, '#(part-\d|nowhere)', '#use-1'), ' "clm-[a-z0-9]+"', ''), '\[next\]\(([^)]*)\)', '[next](\1 "clm-p' || case when length((k + 1)::varchar) < 5 then lpad((k + 1)::varchar, 5, '0') else (k + 1)::varchar end || '")')) as text_md5
  from docs where k % 17 <> 0 and k + 1 in (select p_partkey from part
      where p_partkey % 13 <> 0 or p_partkey % 11 = 0)""",
    lambda d, n, e: migrate.statement_citations(_bare(d), derive.host_anchors(derive.first_markers(T.markers_of(d)), d))[0].select("path", F.md5("text").alias("text_md5")),
)

_OWN = CLP("k")
_MARK = f"'<!-- node-id: ' || {CLP('k').replace('string', 'varchar')} || ' -->'"


def _placed(d, n):
    """Each document lists its own part; parts of keys ending in 3 are no claims; every seventh hosts an analysis."""
    claims = n.where("kind = 'claim' and id like 'clm-p%' and not id like '%3'").select("id", "title")
    hosted = d.where("k % 7 = 0").selectExpr("concat('ana-', lpad(cast(k as string), 6, '0')) as id", "path", "1 as line")
    script, _, _ = edits.placed_markers(d.select("path", "text"), claims, d.selectExpr("path", f"{_OWN} as id"), hosted)
    return edits.apply_edits(d.select("path", "text"), script).select("path", F.md5("text").alias("text_md5"), F.size("refused").alias("refused"))


on_docs(
    "placed_markers",
    f"""select path, md5(case when k % 7 = 0 then replace(b, chr(10) || h || chr(10), chr(10) || h || chr(10) || '<!-- node-id: ana-' || lpad(k::varchar, 6, '0') || ' -->' || chr(10)) else b end) as text_md5, 0::int as refused
  from (select path, k, case when k % 10 <> 3 and k % 13 = 0 and k % 11 <> 0 then replace(a, chr(10) || t || chr(10), chr(10) || t || ' ' || m || chr(10)) else a end as b, case when k % 10 <> 3 and k % 13 = 0 and k % 11 <> 0 then t || ' ' || m else t end as h
  from (select path, k, m, '# Part ' || k % 7 as t, case when k % 10 = 3 then replace(text, ' ' || m, '') when k % 13 <> 0 and k % 11 = 0 then replace(text, '> Again ' || k || '. ' || m, '> Again ' || k || '.') else text end as a
  from (select *, {_MARK} as m from docs)))""",
    lambda d, n, e: _placed(d, n),
)

_NEW = ids.derived_sql("clm", "id")
on_docs(
    "renamed_prose",
    f"""select path, md5(replace(replace(replace(text, coalesce(a.id, '?'), coalesce(a.new, '')), coalesce(b.id, '?'), coalesce(b.new, '')), coalesce(c.id, '?'), coalesce(c.new, ''))) as text_md5
  from docs left join (select id, {_NEW} as new from n) a on a.id = {CLS('(k % 10)').replace('string', 'varchar')} and k % 5 <> 0
      left join (select id, {_NEW} as new from n) b on b.id = {CLP('k').replace('string', 'varchar')} left join (select id, {_NEW} as new from n) c on c.id = {CLP('(k + 1)').replace('string', 'varchar')}""",
    lambda d, n, e: rename.renamed(d.select("path", "text"), ids.mint(n.select(F.col("id").alias("seed")), "clm").select(F.col("seed").alias("old"), F.col("id").alias("new")), scope="all").select("path", F.md5("text").alias("text_md5")),
)
