"""Queries over documents: the star's Markdown tree, whose faults and order follow from keys, and the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.operators import derive, query, score, verify
from argosy.plans.registry import on_docs, on_tables

_PATH = "'parts/p' || p_partkey || '.md'"
_ID = "'clm-p' || case when length(p_partkey::varchar) < 5 then lpad(p_partkey::varchar, 5, '0') else p_partkey::varchar end"
_NEXT = _ID.replace("p_partkey", "(p_partkey + 1)")
_MARKED = "(p_partkey % 13 <> 0)::int + (p_partkey % 11 = 0)::int"
_FIRST = f"(select {_ID} as id, {_PATH} as path, case when p_partkey % 13 <> 0 then 17 else 19 end as line, p_partkey as k from part where {_MARKED} > 0)"
_CHILDREN = ", t as (select p_partkey as parent, c as child from k, range(1, 11) r(j), lateral (select 10 * p_partkey + j as c) where c < n_parts and c % 31 <> 0)"
_ORDER = f"""{_CHILDREN}, w as (with recursive r(k, key) as (select 0::bigint, []::bigint[] union all select t.child, list_append(r.key, t.child) from r join t on t.parent = r.k) select k, row_number() over (order by key) - 1 as position from r)"""

# lines, headings, links, ids
on_docs(
    "heading_anchors",
    f"select {_PATH} as path, unnest([3, 13, 15])::int as line, unnest(['part-' || p_partkey % 7, 'use', 'use-1']) as anchor from part",
    lambda d, n, e: T.headings_of(d).select("path", "line", "anchor"),
)
on_docs("citations_of", f"select {_PATH} as path, 7::int as line, 'next' as text from part where {_NEXT} = 'clm-p00007'", lambda d, n, e: query.citations_of(d, "clm-p00007"))
on_docs(
    "citations",
    f"select {_PATH} as path, 7::int as line, {_NEXT} as id from part",
    lambda d, n, e: T.links_of(d).where("link.title <> ''").select("path", "line", F.col("link.title").alias("id")),
)
on_docs(
    "marker_cardinality",
    f"select 'marker cardinality' as \"check\", {_ID} as subject, ({_MARKED})::varchar as detail from part where {_MARKED} <> 1",
    lambda d, n, e: verify.marker_faults(n.where("id like 'clm-p%'"), d),
)
on_docs(
    "unknown_ids",
    f"select 'unknown id' as \"check\", {_PATH} || ':5' as subject, 'clm-qqqqqq' as detail from part where p_partkey % 5 = 0",
    lambda d, n, e: verify.unknown_ids(n, d),
)
on_docs(
    "bare_ids",
    f"select 'bare id' as \"check\", {_PATH} || ':5' as subject, 'clm-s0000' || p_partkey % 10 as detail from part where p_partkey % 5 <> 0",
    lambda d, n, e: verify.bare_known_ids(n, d),
)
on_docs(
    "dead_links",
    f"""select case when p_partkey % 17 = 0 or p_partkey + 1 = n_parts then 'dead link' else 'dead fragment' end as "check", {_PATH} || ':7' as subject,
  case when p_partkey % 17 = 0 then 'q' else 'p' end || (p_partkey + 1) || '.md#' || case when p_partkey % 19 = 0 then 'nowhere' else 'part-' || (p_partkey + 1) % 7 end as detail
  from k where p_partkey % 17 = 0 or p_partkey % 19 = 0 or p_partkey + 1 = n_parts""",
    lambda d, n, e: verify.dead_links(d),
)
on_docs(
    "hand_mentions",
    f"select {_PATH} as path, unnest([1, 2]) as rank, 'lemma' as kind, unnest(['2.1', '2.' || p_partkey % 5]) as number, null::varchar as through from part",
    lambda d, n, e: M.mentions_of(d),
)
on_docs(
    "statements",
    f"""select {_ID} as id, case when p_partkey % 13 <> 0 then 'Statement ' || p_partkey || '. Its size is ' || p_size || '.' else 'Again ' || p_partkey || '.' end as statement
      from part where {_MARKED} > 0""",
    lambda d, n, e: M.statements_of(d),
)
# the index
on_docs("first_markers", f"select id, path, line::int as line from {_FIRST}", lambda d, n, e: derive.first_markers(T.markers_of(d)).select("id", "path", "line"))
on_docs("host_anchors", f"select id, path, 'use-1' as anchor from {_FIRST}", lambda d, n, e: derive.host_anchors(derive.first_markers(T.markers_of(d)), d))
on_docs("cites", f"select id as claim, path as leaf from {_FIRST}", lambda d, n, e: derive.cites(n, T.markers_of(d)))
on_docs(
    "claim_counts",
    f"""select n.id, coalesce(p.premises, 0)::bigint as premises, (f.id is not null)::bigint as citations
      from n left join (select target, count(*) as premises from e where relation in ('supports', 'founds')
      group by 1) p on n.id = p.target
  left join {_FIRST} f on n.id = f.id where n.kind = 'claim'""",
    lambda d, n, e: derive.claim_counts(n, e, derive.cites(n, T.markers_of(d))),
)
on_docs(
    "volume_claims",
    f"select 'parts' as volume, count(*) as claims, 0::bigint as experiments from {_FIRST} union all select 'events', 0, count(*) from n where kind = 'experiment'",
    lambda d, n, e: derive.volume_claims(derive.cites(n, T.markers_of(d)), n),
)
on_docs(
    "child_lists",
    f"""{_CHILDREN} select 'parts/p' || parent || '.md' as parent, (row_number() over (partition by parent
      order by child) - 1)::int as position, 'parts/p' || child || '.md' as child
      from t""",
    lambda d, n, e: derive.child_lists(d),
)
on_docs(
    "tree_links",
    f"""{_CHILDREN}, u as (select p_partkey as child, case when p_partkey % 29 = 0 then 0 else (p_partkey - 1) // 10 end as parent
      from part where p_partkey > 0)
  select 'not in child list' as "check", 'parts/p' || child || '.md' as subject, 'parts/p' || parent || '.md' as detail
      from (select child, parent from u except all select child, parent from t)
  union all select 'no up-link', 'parts/p' || child || '.md', 'parts/p' || parent || '.md'
      from (select child, parent from t except all select child, parent from u)""",
    lambda d, n, e: verify.inverse_links(derive.up_links(d), derive.child_lists(d)),
)
on_docs(
    "unreached",
    f"{_ORDER} select 'unreached' as \"check\", {_PATH} as subject, 'parts/p0.md' as detail from part where p_partkey not in (select k from w)",
    lambda d, n, e: verify.unreached(derive.child_lists(d), "parts/p0.md", d.select("path")),
)
on_docs("reading_order", f"{_ORDER} select 'parts/p' || k || '.md' as path, position from w", lambda d, n, e: derive.reading_positions(derive.child_lists(d), "parts/p0.md"))
_HOSTED = f"{_ORDER}, h as (select id, row_number() over (order by position nulls last, path, id) - 1 as rank from {_FIRST} f left join w on f.k = w.k)"
_hosted = lambda d: derive.hosted_order(derive.first_markers(T.markers_of(d)), derive.reading_positions(derive.child_lists(d), "parts/p0.md"))
on_docs("hosted_order", f"{_HOSTED} select id, rank from h", lambda d, n, e: _hosted(d))
on_docs(
    "global_sequence",
    f"{_HOSTED} select n.id, row_number() over (order by rank nulls last, n.id) - 1 as seq from n left join h on n.id = h.id",
    lambda d, n, e: derive.sequence(n, _hosted(d)),
)
on_docs(
    "index_edges",
    """select relation, source, target, context, row_number() over (order by source, target, coalesce(context, ''), relation, coalesce(replaced_relation, '')) - 1 as rank
      from e""",
    lambda d, n, e: derive.index_edges(e),
)
on_docs(
    "edge_paths",
    f"""select source, target, case when a.path = b.path then 'document' else 'directory' end as locality
      from e join {_FIRST} a on e.source = a.id join {_FIRST} b on e.target = b.id
      where relation = 'references'""",
    lambda d, n, e: derive.localities(e.where("relation = 'references'"), derive.first_markers(T.markers_of(d))),
)

# the text tables
_STOP = "', '".join(sorted(T.STOPWORDS))
_FOLDED = r"""regexp_replace(regexp_replace(translate(x, 'Σ', 'σ'), '\[([^\[\]]*)\]\([^()]*\)', '\1', 'g'), '<!--.*?-->|</?[A-Za-z][^<>]*>', '', 'g')"""
_SIGNS = r"flatten(list_transform(regexp_extract_all(x, '\$`([^`]*)`\$', 1), lambda y: regexp_extract_all(y, '\\[A-Za-z]+(?:_\{[^{}]*\}|_[A-Za-z0-9])?|[A-Za-z](?:_\{[^{}]*\}|_[A-Za-z0-9])')))"


def _terms_sql(key: str, column: str, table: str) -> str:
    return rf"""with t as (select {key} as id, coalesce({column}, '') as x from {table}),
w as (select id, list_filter(list_transform(regexp_extract_all({_FOLDED}, '[\p{{L}}\p{{N}}]+'), lambda y: lower(y)), lambda y: length(y) > 2 and not regexp_full_match(y, '\p{{Nd}}+') and not list_contains(['{_STOP}'], y)) as words,
  list_transform(list_filter({_SIGNS}, lambda y: not list_contains(['{_STOP}'], lower(string_split(ltrim(y, '\'), '_')[1]))), lambda y: 'm:' || regexp_replace(y, '_\{{(\w)\}}', '_\1', 'g')) as signs from t)
select id as {key}, len(words || signs)::int as n_terms, md5(array_to_string(words || signs, ' ')) as terms_md5 from w"""


for _name, _key, _column, _table in (("canonical_terms", "doc_id", "text", "documents"), ("page_terms", "page_id", "html", "pages"), ("turn_terms", "conv_id", "text", "conversations")):
    on_tables(
        _name,
        _terms_sql(_key, _column, _table),
        lambda d, k=_key, c=_column: d.select(k, T.terms_of(F.coalesce(F.col(c), F.lit(""))).alias("t")).select(k, F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5")),
        _table,
    )
#: Ends of sentences in one paragraph of collapsed white space: texts are split at stops, and each piece is checked with what follows and what stands before.
_SENTENCES = rf"""with t as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')) as x from documents),
s as (select doc_id, x, regexp_extract_all(x, '[.!?]["'')\]*_`»”’]* ') as stops, regexp_split_to_array(x, '[.!?]["'')\]*_`»”’]* ') as parts from t),
p as (select doc_id, x, generate_subscripts(parts, 1) as i, unnest(parts) as part, unnest(list_append(stops, '')) as stop from s),
q as (select *, part || stop as piece, lead(part || stop) over (partition by doc_id order by i) as next, string_agg(part || stop, '') over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as head from p),
e as (select doc_id, x, stop <> '' and regexp_matches(coalesce(next, ''), '^[A-Z0-9$\\`*_(\["''#—-]') and not list_contains(['{"', '".join(sorted(T.ABBREVIATIONS))}'], lower(tok)) and not regexp_full_match(tok, '[A-Za-z]\.') and
  (length(h) - length(replace(h, '$', ''))) % 2 = 0 and (length(h) - length(replace(h, '`', ''))) % 2 = 0 as cut
  from (select *, regexp_extract(coalesce(head, '') || rtrim(piece), '[^ ]*$') as tok, regexp_replace(coalesce(head, '') || part, '\\[$`]', '', 'g') as h from q))
select doc_id, (count(*) filter (cut) + max((x <> '')::int))::int as n_sentences from e group by doc_id"""
on_tables(
    "sentence_counts",
    _SENTENCES,
    lambda d: d.select("doc_id", F.size(T.udf(lambda x: T.sentences(T.normal_space(x)), "array<string>")(F.coalesce("text", F.lit("")))).alias("n_sentences")),
    "documents",
)
on_tables(
    "closed_lines",
    None,
    lambda d: d.select("doc_id", T.udf(lambda x: score.numbered(score.closed_text([("a", x)])), "string")(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", F.size(F.split("t", "\n")).alias("n_lines"), F.sha2("t", 256).alias("text_sha256")),
    "documents",
)
