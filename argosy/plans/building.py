"""Queries of the build: sections, words, facts, claims, equations, dependencies, splits, gates and the whole report of faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosy.functions import text as T
from argosy.operators import derive, documents, enclosing, ids, search, stages, verify
from argosy.plans import loops
from argosy.plans.registry import on_docs, on_tables
from argosy.plans.texts import _FIRST, _ID, _MARKED, _PATH

on_docs(
    "sections",
    f"""select {_PATH} as path, unnest([0, 1, 2, 3])::int as n, unnest([0, 1, 2, 2])::int as level, unnest(['', 'Part ' || p_partkey % 7, 'Use', 'Use']) as title, unnest([1, 3, 13, 15])::int as line, unnest([null, 0, 1, 1])::int as parent
      from part""",
    lambda d, n, e: documents.sections(d).drop("segment"),
)
on_docs(
    "section_paths",
    f"select {_PATH} as path, unnest([1, 2, 3])::int as n, unnest(['part-' || p_partkey % 7, 'use', 'use-1']) as slug from part",
    lambda d, n, e: documents.section_paths(documents.sections(d)),
)
on_docs("own_prose", f"select {_PATH} as path, 1::int as n from part", lambda d, n, e: documents.own_prose(documents.sections(d)))
_WORDS = r"regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<!--.*?-->', ' ', 'g'), '(?m)^(#+ |> |- )', '', 'g'), '\[([^\[\]]*)\]\([^()]*\)', '\1', 'g'), '[`*]', '', 'g'), '\S+')"
on_docs(
    "lost_words",
    f"""select path, word, (case when k % 23 = 0 and k % 37 <> 0 then c else 0 end)::bigint as lost, (case when k % 37 = 0 and k % 23 <> 0 then c else 0 end)::bigint as added
  from (select path, k, word, count(*) as c from (select path, k, unnest({_WORDS.format("'## Use' || split_part(text, '## Use', 3)")}) as word
      from docs) group by all) where (k % 23 = 0) <> (k % 37 = 0)""",
    lambda d, n, e: documents.lost_words(d, (s := documents.sections(d.drop("k")).join(d.select("path", "k"), "path")).where("n < 3 or k % 23 <> 0").unionByName(s.where("n = 3 and k % 37 = 0"))),
)
on_docs(
    "misaligned",
    f"""select 'heading alignment' as \"check\", {_PATH} || ' 1' as subject, 'other words' as detail
      from part where p_partkey % 9 = 0 union all select 'heading alignment', {_PATH} || ' 4', 'not rendered'
      from part where p_partkey % 10 = 0 union all select 'heading alignment', {_PATH} || ' 3', 'not in the outline'
      from part where p_partkey % 8 = 0""",
    lambda d, n, e: documents.misaligned(
        d.select("path", F.explode(F.array(
            F.struct(F.lit(1).alias("n"), F.concat(F.lit("Part "), F.when(F.col("k") % 9 == 0, F.lit("x")).otherwise((F.col("k") % 7).cast("string"))).alias("title")), F.struct(F.lit(2).alias("n"), F.lit("Use").alias("title")),
            F.when(F.col("k") % 8 != 0, F.struct(F.lit(3).alias("n"), F.lit("Use").alias("title"))), F.when(F.col("k") % 10 == 0, F.struct(F.lit(4).alias("n"), F.lit("More").alias("title"))),
        )).alias("x")).where("x is not null").select("path", "x.*"), documents.sections(d)),
)
on_docs(
    "rewritten_links",
    f"""select path, md5(replace(text, '](p' || (k + 1) || '.md#part-' || (k + 1) % 7, '](../other/p' || (k + 1) || '.md#part-' || (k + 1) % 7)) as text_md5 
      from docs where k % 17 <> 0 and k % 19 <> 0 and k % 3 = 0""",
    lambda d, n, e: documents.rewritten(d, d.where("k % 17 <> 0 and k % 19 <> 0 and k % 3 = 0").selectExpr("path", "concat('p', k + 1, '.md#part-', (k + 1) % 7) as old", "concat('../other/p', k + 1, '.md#part-', (k + 1) % 7) as new")).select("path", F.md5("text").alias("text_md5")),
)
on_docs(
    "inventory_census",
    f"""select kind, name, count(*) as n, count(distinct path) as documents from (select {_PATH} as path, unnest(['heading', 'heading', 'heading', 'fence', 'link', 'mention', 'mention']) as kind, unnest(['1', '2', '2', '', 'citation', 'lemma', 'lemma']) as name
      from part
  union all select {_PATH}, 'marker', 'clm' from part, range({_MARKED})
      union all select {_PATH}, 'link', 'plain' from part where p_partkey > 0
  union all select 'parts/p' || parent || '.md', 'link', 'plain' from (select p_partkey as parent, 10 * p_partkey + j as c, n_parts
      from k, range(1, 11) r(j)) where c < n_parts and c % 31 <> 0) group by 1, 2""",
    lambda d, n, e: stages.census(stages.facts(d)),
)
# Passages of the benchmark's items in all documents; places follow from the pieces between hits.
on_tables(
    "excerpt_search",
    r"""with d as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^([ \t]{0,3}>[ \t]?)+', ''), '\s+', ' ', 'g'))) as rows from documents),
  b as (select doc_id, rows, array_to_string(rows, ' ') as body from d),
  e as (select item_id, trim(regexp_replace(left(text, 60), '\s+', ' ', 'g')) as x from benchmark where trim(left(text, 60)) <> ''),
  h as (select item_id, doc_id, rows, x, generate_subscripts(ps, 1) as i, unnest(ps) as p from (select *, string_split(body, x) as ps from b join e on contains(body, x))),
  o as (select item_id, doc_id, rows, sum(length(p)) over w + (i - 1) * length(x) as spot, i = max(i) over (partition by item_id, doc_id) as rest from h window w as (partition by item_id, doc_id order by i))
  select item_id as id, doc_id::varchar as path, (select count(*) from (select unnest(range(1, len(rows) + 1)) as j) where j = 1 or list_sum(list_transform(rows[:j - 1], lambda y: length(y) + 1)) <= spot)::int as line from o where not rest""",
    lambda b, d: search.search(b.select(F.col("item_id").alias("id"), F.left("text", F.lit(60)).alias("text")), d.select(F.col("doc_id").cast("string").alias("path"), "text"), loose=False),
    "benchmark",
    "documents",
)
_HOSTED = "select path, k, unnest(['heading', 'link', 'fence', 'heading', 'heading']) as kind, unnest(['1', 'citation', '', '2', '2']) as name, unnest([3, 7, 9, 13, 15]) as line, unnest(['h3', 'h3', 'f9', 'h13', 'h15']) as host, unnest([1, 1, 2, 2, 2]) as depth from docs"
on_docs(
    "fact_hosts",
    f"""select path, kind, name, line::int as line, host, depth::int as depth, row_number() over (partition by path, host order by line) as \"at\" from ({_HOSTED}
      union all select path, k, 'marker', 'clm', 17, 'h15', 2 from docs where k % 13 <> 0 union all select path, k, 'marker', 'clm', 19, 'h15', 2 from docs where k % 11 = 0)""",
    lambda d, n, e: enclosing.innermost(stages.facts(d).where("line > 0 and (kind <> 'link' or name = 'citation')"), stages.blocks(d)),
)
on_tables(
    "enclosing_blocks",
    """with s as (select distinct o_orderpriority as path, w, o_orderkey - o_orderkey % w as start from orders, (select unnest([10, 100, 1000]) as w)
      where w = 1000 or (w = 100 and (o_orderkey - o_orderkey % 100) % 300 <> 0) or (w = 10 and (o_orderkey - o_orderkey % 10) % 40 = 0)),
  p as (select o_orderpriority as path, o_orderkey as line, arg_min(w || ':' || start, w) as host, count(*) as depth from orders join s on s.path = o_orderpriority and o_orderkey >= start and o_orderkey < start + w group by 1, 2)
  select path, line, host, depth::int as depth, row_number() over (partition by path, host order by line) as "at" from p""",
    lambda o: enclosing.innermost(
        o.select(F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("line")),
        o.select(F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("k"), F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000))).alias("w")).withColumn("start", F.col("k") - F.col("k") % F.col("w"))
        .where("w = 1000 or (w = 100 and start % 300 <> 0) or (w = 10 and start % 40 = 0)").select("path", "start", (F.col("start") + F.col("w")).alias("stop"), F.concat_ws(":", "w", "start").alias("id")).distinct(),
    ),
    "orders",
)
on_docs(
    "first_lines_look",
    f"select n.id, case when f.line = 19 then 'block' else 'prose' end as look from n left join {_FIRST} f using (id) where kind = 'claim'",
    lambda d, n, e: stages.visual_kinds(n, (x := d.withColumn("text", F.replace("text", F.lit("> Again"), F.lit("> **Lemma** again")))), derive.first_markers(T.markers_of(x))),
)
on_docs(
    "analyses_split",
    f"""select {_ID} as id, {_PATH} as document, 17::int as line, 'Statement ' || p_partkey || '.' as title, 'Its size is ' || p_size || '.' as rest
      from part where p_partkey % 13 <> 0""",
    lambda d, n, e: stages.splits(d),
)
on_docs(
    "own_equations",
    f"select {_PATH} as path, 1::int as n, 9::int as start from part",
    lambda d, n, e: stages.contained(
        stages.facts(d).where("kind = 'fence'").select("path", F.col("line").alias("start"), (F.col("line") + 3).alias("stop")),
        documents.sections(d).select("path", "n", F.col("line").alias("start"), (F.col("line") + F.size(F.split("segment", "\n"))).alias("stop")),
    ).select("inner.path", "outer.n", "inner.start"),
)
on_tables(
    "claims_discovered",
    r"""with p as (select doc_id, generate_subscripts(ps, 1) - 1 as spot, trim(regexp_replace(unnest(ps), '\s+', ' ', 'g')) as x
      from (select doc_id, regexp_split_to_array(coalesce(text, ''), '\n[ \t]*\n') as ps
      from documents)),
  c as (select doc_id, spot from p where x <> '' and not starts_with(x, '#') and len(regexp_extract_all(x, '[\p{L}\p{N}]+')) >= 4)
      select doc_id::varchar as host, spot::int as "at", """ + ids.derived_sql("clm", "doc_id || ':' || spot") + """ as id from c where (doc_id + spot) % 2 = 0""",
    lambda d: stages.discovered(
        p := stages.paragraphs(d.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))),
        p.select("path", "at", F.when((F.col("path").cast("long") + F.col("at")) % 2 == 0, "A").otherwise("B").alias("letter")),
    ).select("host", "at", "id"),
    "documents",
)
on_tables(
    "equations_minted",
    f"""select o_orderpriority as document, o_custkey as label, min(o_orderkey) as start, {ids.derived_sql("clm", "o_orderpriority || ':' || o_custkey")} as id
      from orders where o_orderkey % 3 <> 0 and o_custkey in (select c_custkey
      from customer where c_custkey % 4 = 1) group by 1, 2""",
    lambda o, c: stages.unheld(
        o.select(F.col("o_orderpriority").alias("document"), F.col("o_custkey").alias("label")).join(c.where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("label")), "label", "left_semi"),
        o.select(F.col("o_orderpriority").alias("document"), F.col("o_custkey").alias("label"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") % 3 == 0).alias("held")),
    ),
    "orders",
    "customer",
)
on_tables(
    "depends_attributed",
    f"""{loops._SQL}, q as (select g.*, k % 10 as m, k - k % 10 + 9 < (select count(*)
      from customer) as whole from g join z on g.source = z.id where k % 10 <> 8)
  select case when whole and target < source then 'demoted' else 'supports' end as relation, case when whole and target < source then 'supports' end as replaced_relation, source, target
      from q""",
    lambda c: stages.attributed(
        loops._rings(c).select("source", "target", F.array(F.lit("supports"), F.lit("lifts")).alias("allowed")),
        loops._rings(c).join(c.selectExpr(f"{loops._C.format(0)} as source", "c_custkey as k"), "source").select("source", "target", F.when(F.col("k") % 10 == 8, "founds").otherwise("supports").alias("relation")),
        loops._kinds(c).withColumn("kind", F.lit("claim")), loops._rings(c).limit(0),
    ),
    "customer",
)
on_tables(
    "stage_tally",
    """select 'priority' as what, o_orderpriority as value, count(*) as n from orders
      group by 2 union all select 'status', o_orderstatus, count(*) from orders
      group by 2""",
    lambda o: stages.tally(("priority", o, "o_orderpriority"), ("status", o, "o_orderstatus")),
    "orders",
)


def _front(d):
    return d.withColumn("text", F.when(F.col("k") % 41 == 0, F.concat(F.lit("---\nkind: leaf\n---\n"), "text")).otherwise(F.col("text")))


on_docs(
    "frontmatter",
    f"select 'frontmatter' as \"check\", {_PATH} || ':1' as subject, '' as detail from part where p_partkey % 41 = 0",
    lambda d, n, e: verify.frontmatter(_front(d)),
)
on_docs(
    "demoted_edges",
    "select 'demoted' as \"check\", source || ' ' || target as subject, replaced_relation as detail from e where relation = 'demoted'",
    lambda d, n, e: verify.demoted(e),
)
on_docs(
    "verify_report",
    f"""select "check", count(*) as n from (select 'marker cardinality' as "check"
      from n where kind in ('claim', 'analysis', 'experiment') and id not in (select {_ID}
      from part where {_MARKED} = 1) union all select 'unknown id' from part where p_partkey % 5 = 0
  union all select 'bare id' from part where p_partkey % 5 <> 0 union all
      select case when p_partkey % 17 = 0 or p_partkey + 1 = n_parts then 'dead link' else 'dead fragment' end
      from k where p_partkey % 17 = 0 or p_partkey % 19 = 0 or p_partkey + 1 = n_parts
  union all select 'frontmatter' from part where p_partkey % 41 = 0 union all
      select 'axiom heading' from n where kind = 'axiom' union all select 'demoted'
      from e where relation = 'demoted' union all select 'page' from part where p_partkey % 43 = 0)
      group by 1""",
    lambda d, n, e: verify.report(
        n, e, _front(d), axioms=n.where("kind = 'axiom'").select("id", "label", "title"), headings=n.limit(0).select("id", F.col("title").alias("heading")),
        wanted=d.select("path", "text"), standing=d.select("path", F.when(F.col("k") % 43 == 0, "old").otherwise(F.col("text")).alias("text")),
    ).groupBy("check").agg(F.count(F.lit(1)).alias("n")),
)
