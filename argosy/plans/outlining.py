"""Queries on the walk of a tree of documents: regions as volumes, nations as indexes below them, suppliers as documents.

Every third nation lists its suppliers in falling order; some suppliers are listed by their region too (before or after their nation), by another region, or don't exist; the
entry lists a volume twice, one that isn't there, and a document that is none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from argosy.operators import outline
from argosy.plans.registry import on_tables

_SUPPLIER = "'region-' || n_regionkey || '/n' || n_nationkey || '/S ' || s_suppkey || '.md'"
_JOINED = "{supplier} join {nation} on s_nationkey = n_nationkey"
CHILDREN = f"""select 'kb.md' as parent, cast(r_regionkey as int) as position, 'region-' || r_regionkey || '/index.md' as child from {{region}}
  union all select 'kb.md', 99, 'region-1/index.md' union all select 'kb.md', 98, 'region-77/index.md' union all select 'kb.md', 97, 'about.md'
  union all select 'region-' || n_regionkey || '/index.md', cast(100000 * n_nationkey + 5 as int), 'region-' || n_regionkey || '/n' || n_nationkey || '/index.md' from {{nation}}
  union all select 'region-' || n_regionkey || '/n' || n_nationkey || '/index.md', cast(case when n_nationkey % 3 = 0 then -s_suppkey else s_suppkey end as int), {_SUPPLIER} from {_JOINED}
  union all select 'region-' || n_regionkey || '/index.md', cast(100000 * n_nationkey + case when s_suppkey % 2 = 0 then 4 - s_suppkey else 6 + s_suppkey end as int), {_SUPPLIER} from {_JOINED} where s_suppkey % 17 = 0
  union all select 'region-' || (n_regionkey + 1) % 5 || '/index.md', cast(90000000 + s_suppkey as int), {_SUPPLIER} from {_JOINED} where s_suppkey % 29 = 0"""
FILES = f"""select 'region-' || r_regionkey || '/index.md' as path from {{region}} union all select 'region-' || n_regionkey || '/n' || n_nationkey || '/index.md' from {{nation}}
  union all select {_SUPPLIER} from {_JOINED} where s_suppkey % 13 <> 0"""

_PLAIN = {t: t for t in ("region", "nation", "supplier")}
_SQL = rf"""with recursive ch as ({CHILDREN.format(**_PLAIN)}), fi as ({FILES.format(**_PLAIN)}),
  vol as (select row_number() over (order by min(position)) as volume, child as path, regexp_replace(child, '/[^/]*$', '') as dir from ch where parent = 'kb.md' and ends_with(child, '/index.md') and child in (select path from fi) group by child),
  li as (select ch.*, p.volume as v, c.volume as w, child in (select path from fi) as stands from ch join vol p on starts_with(parent, p.dir || '/') left join vol c on starts_with(child, c.dir || '/') where ends_with(parent, '/index.md')),
  al as (select path, [volume::int] as key, [path] as trail from vol union all select child, list_append(key, position), list_append(trail, child) from al join li on parent = path where v = w and stands),
  best as (select path, min({{'k': key, 't': trail}}) as m from al group by path),
  o as (select path, row_number() over (partition by m.t[-2] order by m.k[-1]) as ordinal from best),
  nu as (select path, string_agg(ordinal::varchar, '.' order by i) as number from (select path, unnest(m.t) as step, generate_subscripts(m.t, 1) as i from best) s join (select path as step, ordinal from o) using (step) group by path),
  su as (select step as path, count(*) as size from (select unnest(m.t) as step from best) group by 1),
  tour as (select b.path, volume, len(m.k) - 1 as rank, number, row_number() over (order by m.k) - 1 as first, size,
    case when b.path = vol.path then 'vol' || volume else 'd' || volume || '-' || trim(regexp_replace(lower(regexp_replace(b.path[length(dir) + 2:], '\.[^./]*$', '')), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-') end as label
    from best b join nu using (path) join su using (path) join vol on starts_with(b.path, dir || '/'))
"""


def _walk(r, n, s):
    tables = {"region": r, "nation": n, "supplier": s}
    return outline.walk(r.sparkSession.sql(CHILDREN, **tables), r.sparkSession.sql(FILES, **tables), "kb.md")


on_tables(
    "walked_documents",
    f"{_SQL} select path, volume::int as volume, rank::int as rank, number, first, first + size - 1 as last, case when first = min(first) over (partition by label) then label else '' end as label from tour",
    lambda r, n, s: _walk(r, n, s).documents,
    "region", "nation", "supplier",
)
on_tables(
    "walk_findings",
    f"""{_SQL} select 'volume again' as "check", 'kb.md' as subject, 'region-1/index.md' as detail union all select 'no such volume', 'kb.md', 'region-77/index.md'
  union all select case when w is distinct from v then 'outside its volume' when not stands then 'no such document' else 'walked already' end, parent, child from li
    where w is distinct from v or not stands or not exists (select 1 from best where best.path = child and m.t[-2] = parent and m.k[-1] = position)""",
    lambda r, n, s: _walk(r, n, s).findings,
    "region", "nation", "supplier",
)
on_tables(
    "selected_volumes",
    f"""{_SQL}, x as (select *, dense_rank() over (order by volume) as nv from tour where volume in (2, 4, 5))
  select path, nv::int as volume, rank::int as rank, regexp_replace(number, '^\\d+', nv::varchar) as number, row_number() over (order by first) - 1 as first, row_number() over (order by first) - 2 + size as last, regexp_replace(label, '^(vol|d)\\d+', '\\1' || nv) as label from x""",
    lambda r, n, s: outline.selected(_walk(r, n, s), r.sparkSession.createDataFrame([(2,), (4,), (5,), (9,)], "volume int")).documents,
    "region", "nation", "supplier",
)
on_tables(
    "bibliography_entries",
    f"""{_SQL}, en as (select {_SUPPLIER} as path, s_suppkey as line, 'key' || s_suppkey % 40 as key from supplier join nation on s_nationkey = n_nationkey)
  select key, arg_min(path, z) as path, arg_min(line, z) as line from (select en.*, row_number() over (order by first nulls last, path, line) as z from en left join tour using (path)) group by key""",
    lambda r, n, s: outline.first_entries(r.sparkSession.sql(f"select {_SUPPLIER} as path, s_suppkey as line, 'key' || s_suppkey % 40 as key from {_JOINED}", nation=n, supplier=s), _walk(r, n, s).documents)[0],
    "region", "nation", "supplier",
)
