"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, credentials, decontaminate, jaccard, linededup, mixing, pieces, pii, quality, repair, spans, topk, toxicity
from .common import sha256_hex, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "n_holdout", *[f"cutoff_{s}" for s in quality.GRID])


OP1 = r"""
with w as materialized (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
p as (select r, i from g qualify count(*) over (partition by r, g) > 1),
n as (select r, count(*) as n_repeat_words from (select distinct r, i + d as at from p, (select unnest([0, 1, 2]) as d)) group by r),
l as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
c as materialized (select doc_id, case when lang in ('en', 'de', 'fr', 'es') then lang else 'other' end as stratum, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join n on w.r = n.r left join l on w.r = l.r),
s as (select *, case when n_words > 0 then n_symbols / n_words else 0 end as symbols, case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_lines,
  case when n_words > 0 then n_repeat_words / n_words else 0 end as repeat_words, case when n_words > 0 then word_chars / n_words else 0 end as word_length from c),
m as (select doc_id, min(quality) as quality from labels where quality in (0, 1) group by 1),
o as (select s.doc_id, min(stratum) as s, min(m.quality) as quality, max(symbols) as symbols, max(dup_lines) as dup_lines, max(repeat_words) as repeat_words, max(word_length) as word_length from s join m on s.doc_id = m.doc_id group by 1),
own as (select s from o group by 1 having sum(quality) >= ceil(ln(0.05::double / 24) / ln(0.995::double))),
q as (select case when s in (select s from own) then s else 'pool' end as stratum, quality, unnest([{'s': 'symbols', 'b': least(64, ceil(symbols * 64))}, {'s': 'dup_lines', 'b': least(64, ceil(dup_lines * 64))}, {'s': 'repeat_words', 'b': least(64, ceil(repeat_words * 64))}, {'s': 'word_length', 'b': least(64, ceil(word_length * 2))}]) as x from o),
f as (select stratum, x.s as signal, x.b::int as bin, sum(quality) as good, sum(1 - quality) as bad from q group by all),
d as (select * from (select unnest(['en', 'de', 'fr', 'es', 'other', 'pool']) as stratum), (select unnest(['symbols', 'dup_lines', 'repeat_words', 'word_length']) as signal), (select unnest(range(65))::int as bin)),
a as (select stratum, signal, bin as step, sum(coalesce(good, 0)) over t as n_good, sum(coalesce(bad, 0)) over t as n_bad, coalesce(sum(coalesce(good, 0)) over u, 0) as n_false, coalesce(sum(coalesce(bad, 0)) over u, 0) as n_true
  from d left join f using (stratum, signal, bin) window t as (partition by stratum, signal), u as (partition by stratum, signal order by bin desc rows between unbounded preceding and 1 preceding)),
e as (select *, case when n_good > 0 and n_false < n_good * 0.005::double then list_sum(list_transform(range(n_false::bigint + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln(0.005::double) + (n_good - j) * ln(0.995::double)))) else 1 end as p_value,
  case when n_bad > 0 then n_true / n_bad else 0 end - case when n_good > 0 then n_false / n_good else 0 end as gain from a where step < 64),
h as (select *, max(p_value) over (partition by stratum, signal order by step desc) <= 0.05::double / 24 as certified from e),
k as (select stratum, signal, (case signal when 'word_length' then 0.5 else 1.0 / 64 end)::double * max({'g': gain, 's': step}).s as cutoff from h where certified and gain > 0 group by stratum, signal),
v as (select stratum, max(cutoff) filter (signal = 'symbols') as a, max(cutoff) filter (signal = 'dup_lines') as b, max(cutoff) filter (signal = 'repeat_words') as c, max(cutoff) filter (signal = 'word_length') as d from k group by 1),
y as (select * replace (case when stratum in (select s from own) then stratum else 'pool' end as stratum) from s),
c2 as (select stratum, max(n_good)::bigint as n_holdout from a group by 1),
z as (select y.*, n_holdout, v.a, v.b, v.c, v.d, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce(symbols > v.a, false) or coalesce(dup_lines > v.b, false) or coalesce(repeat_words > v.c, false) or coalesce(word_length > v.d, false) as rejected
  from y left join v using (stratum) left join c2 using (stratum))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept, stratum, n_holdout, a as cutoff_symbols, b as cutoff_dup_lines, c as cutoff_repeat_words, d as cutoff_word_length from z
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (toxicity.split_of(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(added)
    said = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = chat.read_back(chat.windows(turns)).select(
        "conv_id", "window", "chars", F.size("turns").alias("n"), F.array_join(F.transform("turns", said), "").alias("said"), F.array_join("targets", "").alias("target")
    )
    ordered = F.sort_array(F.collect_list(F.struct("window", "said", "target")))
    whole = read.groupBy("conv_id").agg(ordered.alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = whole.withColumn("said", F.array_join("w.said", "")).withColumn("target", F.array_join("w.target", ""))
    return whole.select(
        "conv_id", F.col("n_turns").cast("long"), sha256_hex(F.col("said")).alias("turns_sha256"),
        F.length("target").cast("long").alias("loss_chars"), sha256_hex(F.col("target")).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )


#: Control strings as in chat.py; the sums of chat.windows with its default budgets.
CONTROL = rf"([<\[])(\\*)({chat.CONTROL})"
OP3 = rf"""
with c as (select conv_id, turn, role, text from conversations union all
  select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
b as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
e as (select *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 as tokens,
  length(regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g')) + length(replace(regexp_replace(role, '{CONTROL}', '\1\\\2\3', 'g'), chr(10), '<|nl|>')) + 17 as width,
  row_number() over (partition by conv_id order by turn nulls first, role, text) as i from b),
p as (select *, sum(tokens) over (partition by conv_id order by i) as upto from e),
g as (select *, case when tokens <= 384 then floor((upto - 1) / 384) end as cell from p),
n as (select *, case when cell = lag(cell) over (partition by conv_id order by i) then 0 else 1 end as fresh from g),
s as (select *, sum(fresh) over (partition by conv_id order by i) as span, min(case when role = 'system' and tokens <= 128 then i end) over (partition by conv_id) as system_i from n),
t as (select *, max(span) over (partition by conv_id) as last, max(upto) over (partition by conv_id, span) - upto + tokens as rest from s),
w as (select conv_id, i, role, text, width * (1 + case when i = system_i then last - span when rest <= 128 and span < last then 1 else 0 end) as chars from t)
select conv_id::bigint as conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars from w group by conv_id
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan_secrets(table(spark, sf_dir, "documents"))
    return _digest(found, credentials.BASE, tuple(credentials.ORDER))


def _any_case(words: str) -> str:
    """A pattern of ASCII letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isascii() and c.islower() else c for c in words)


def _spans_sql(name: str, kind: str, pattern: str, held: str = "true", value: str = "") -> str:
    """CTEs for the spans (r, kind, m, a, b) of a pattern's leftmost matches: their places follow from the pieces between them."""
    p = pattern.replace("'", "''")
    own = f", regexp_extract_all(x, '{p}', {value}) as vs" if value else ""
    return f"""{name}_u as (select r, generate_subscripts(ms, 1) as i, unnest(ms) as m, unnest(ps[1:len(ms)]) as p{', unnest(vs) as v' if value else ''} from (select r, regexp_extract_all(x, '{p}') as ms, string_split_regex(x, '{p}') as ps{own} from t where regexp_matches(x, '{p}'))),
{name} as (select r, '{kind}' as kind, m, a, a + length(m) as b from (select *, (sum(length(p)) over (partition by r order by i) + coalesce(sum(length(m)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0))::int as a from {name}_u) where {held})"""


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_JOIN = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, k, b) {0}, '')"
OP4 = f"""
with t as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
{_spans_sql('as_', 'assign', f"({_any_case('password|passwd|secret|token|api_?key')}){_VALUE}([A-Za-z0-9+/_.=-]+)", 'length(v) >= 6', '2')},
{_spans_sql('ac', 'access', 'AKIA[A-Z0-9]+', 'length(m) >= 20')},
{_spans_sql('he', 'hex', '[0-9a-f]{24,}')},
{_spans_sql('wi', 'weak_id', rf"\b(?:{_any_case('user')}(?:{_any_case('name')})?|{_any_case('login|client_?id|account_?id|access_?id')}){_VALUE}[A-Za-z0-9@._-]{{3,}}")},
{_spans_sql('ru', 'weak_secret', '[A-Za-z0-9+/_=-]{20,}')},
{_spans_sql('en', 'endpoint', rf"\b(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._-]+(?::[0-9]{{1,5}})?|\bhost{_VALUE}[A-Za-z0-9.-]+\.[A-Za-z0-9.-]+")},
{_spans_sql('ga', 'gap', r'\n[\x20\t]*\n')},
ch as (select r, a, m, ch, count(*) as c from (select r, a, m, unnest(string_split(m, '')) as ch from ru) group by all),
ws as (select ru.* from ru join (select r, a, -sum(c / length(m) * log2(c / length(m))) as h from ch group by r, a) using (r, a)
  where h >= 3.5 and regexp_full_match(m, '[A-Za-z0-9+/_-]{{20,}}={{0,2}}') and regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')),
ba as (select *, 0 as k, 'secret' as role from as_ union all select *, 1, 'id' from ac union all select *, 2, 'secret' from he),
we as (select w.* from (select *, 3 as k, 'id' as role from wi union all select *, 4, 'secret' from ws union all select *, 5, 'endpoint' from en) w where not exists (select 1 from ba where ba.r = w.r and ba.a < w.b and ba.b > w.a)),
pa as (select *, (select count(*) from ga where ga.r = q.r and ga.a <= q.a) as scope from (select *, false as weak from ba union all select *, true from we) q),
li as (select s.r, s.kind as sk, s.a as sa, s.b as sb, o.kind as ok, o.a as oa, o.b as ob from pa s join pa o on s.r = o.r and s.scope = o.scope and s.role = 'secret' and o.role <> 'secret' and o.a - s.b <= 200 and s.a - o.b <= 200),
al as (select r, kind, a, b, k, false as weak from ba union all select distinct we.r, we.kind, we.a, we.b, we.k, true from we join li on we.r = li.r and ((we.kind = li.sk and we.a = li.sa and we.b = li.sb) or (we.kind = li.ok and we.a = li.oa and we.b = li.ob)))
select any_value(doc_id) as doc_id, count(*) filter (kind = 'assign' and not weak) as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256({_JOIN.format('filter (not weak)')}) as base_sha256, {_JOIN.format('')} as spans from t left join al using (r) group by r
"""


def _digest(found: DataFrame, base: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans."""
    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return found.select("doc_id", *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in base], sha256_hex(spans.joined(F.col("base"), kinds)).alias("base_sha256"), spans.joined(F.concat("base", plain), kinds).alias("spans"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_grams", "class_id", "n_links")


#: Exact pairs of distinct n-gram sets, and the groups that they join.
OP5 = r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select doc_id, list_sort(list_distinct(case when len(ws) < 5 then case when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end
  else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) as gs from d),
f as materialized (select row_number() over () as f, gs, len(gs) as g, count(*) as n, min(doc_id) as least from s where len(gs) > 0 group by gs),
x as materialized (select f, g, n, unnest(gs) as gram from f),
p as materialized (select a.f as u, b.f as v, any_value(b.n) as n from x a join x b on a.gram = b.gram and a.f <> b.f group by a.f, b.f having 5 * count(*) >= 4 * (any_value(a.g) + any_value(b.g) - count(*))),
r(u, v) as (select f, f from f union select r.u, p.v from r join p on r.v = p.u),
c as (select r.u, min(least) as class_id from r join f on r.v = f.f group by r.u),
l as (select u, sum(n) as n from p group by u)
select doc_id, len(s.gs)::bigint as n_grams, case when f.f is null then doc_id else class_id end as class_id, (coalesce(l.n, 0) + coalesce(f.n - 1, 0))::bigint as n_links
from s left join f on s.gs = f.gs left join c on c.u = f.f left join l on l.u = f.f
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find_pii(table(spark, sf_dir, "documents")), pii.BASE, pii.KINDS)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


OP7 = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d)),
c as (select k, max(doc_id) as last from l where length(k) >= 20 group by k having count(distinct doc_id) + max((doc_id is null)::int) >= 3),
m as (select l.*, c.k is not null and l.doc_id is distinct from c.last as gone from l left join c using (k))
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by r
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan_for(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9 = r"""
with s as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('9:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) as k from documents),
w as (select source, sum(size)::bigint as source_size from s group by 1),
a as (select *, [3.0, 1.0, 2.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as weight from w),
b as (select *, source_size::double * 2.0::double as cap, cap / weight as ratio, (sum(source_size) over ())::double * 1.5::double as total, sum(weight) over () as weights from a),
c as (select *, (total - coalesce(sum(cap) over r, 0)) / (weights - coalesce(sum(weight) over r, 0)) as level from b
  window r as (order by ratio, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
d as (select *, max(case when ratio > level then level end) over () as water from c),
e as (select source, source_size, case when ratio <= level then cap else water * weight end as target from d),
f as (select s.*, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole,
  coalesce(sum(size) over (partition by s.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from s join e on s.source is not distinct from e.source)
select doc_id, size, source_size::bigint as source_size, target,
  (size * (whole + case when target - whole * source_size > 0 and before + size / 2 <= target - whole * source_size then 1 else 0 end))::bigint as taken from f
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


OP10 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v as q join v on v.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damaged(turns))
    hashes = repair.digests(found.turns).withColumnRenamed("conv_id", "_h")
    every = turns.select(F.col("conv_id").alias("_c")).distinct().join(found.conversations, F.col("_c").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("_c").eqNullSafe(F.col("_h")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col("_c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", sha256_hex(F.lit(""))).alias("repaired_sha256"))


#: CRC-32 by its polynomial, then the cheapest edits turn by turn, least (cost, audit) of each state.
OP11 = r"""
with recursive s as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
f as materialized (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda x: ascii(x)::bigint)), lambda c, b:
  xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end))), 4294967295::bigint) % 20 as fate from s),
g as (select coalesce(conv_id::varchar, 'null') as c, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when fate = 3 then [0, 1] else [0] end) as copy from f where fate <> 0)),
h as (select *, row_number() over (partition by c order by turn nulls first, role, md5(text)) as i, rtrim(text, E' \t\n\x0b\x0c\r') as bare from g),
n as materialized (select *, left(role, 1) as ini, case when bare = '' then 'b' when row_number() over (partition by c, role, text order by i) > 1 then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else 'n' end as fault,
  lag(left(role, 1)) over (partition by c order by i) || left(role, 1) as pair from h),
t as (select c, unnest([{'st': 0, 'w': {'c': 0, 'a': ''}}, {'st': 2, 'w': {'c': 3, 'a': 'I'}}, {'st': 3, 'w': {'c': 6, 'a': 'II'}}]) as x from (select distinct c from n)),
p(c, i, st, w) as (select c, 0::bigint, x.st, x.w from t union all
  select c, i, y.st, min(y.w) from (
    select c, i, unnest(case st when 2 then [{'st': 2, 'w': w}, {'st': 3, 'w': {'c': w.c + 3, 'a': w.a || 'I'}}] when 3 then [{'st': 3, 'w': w}, {'st': 2, 'w': {'c': w.c + 3, 'a': w.a || 'I'}}]
      else [{'st': st, 'w': w}, {'st': 2, 'w': {'c': w.c + 3, 'a': w.a || 'I'}}, {'st': 3, 'w': {'c': w.c + 6, 'a': w.a || 'II'}}] end) as y from (
      select c, i, z.st, min({'c': z.c, 'a': z.a}) as w from (
        select p.c, n.i, unnest(list_filter([{'st': p.st, 'c': p.w.c + 4, 'a': p.w.a || 'D'},
          case when fault in ('n', 't') then case when ini = 's' and p.st = 0 then {'st': 1, 'c': p.w.c + m, 'a': p.w.a || 'K'} when ini = 'u' and p.st <> 2 then {'st': 2, 'c': p.w.c + m, 'a': p.w.a || 'K'} when ini = 'a' and p.st = 2 then {'st': 3, 'c': p.w.c + m, 'a': p.w.a || 'K'} end end,
          case when fault in ('n', 't') then case when p.st = 2 then {'st': 3, 'c': p.w.c + m + 3, 'a': p.w.a || 'R'} else {'st': 2, 'c': p.w.c + m + 3, 'a': p.w.a || 'R'} end end], lambda v: v is not null)) as z
        from p join (select *, case fault when 't' then 3 else 0 end as m from n) n on n.c = p.c and n.i = p.i + 1) group by all)) group by c, i, y.st),
e as (select c, i as n_rows, min(w) as w from p join (select c, max(i) as i from n group by c) l using (c, i) where st in (0, 3) group by all),
u as (select c, w, x, o, sum((x <> 'I')::int) over q as i, sum((x <> 'D')::int) over q - 1 as po, sum((x <> 'D')::int) over (partition by c) % 2 as sys from (select *, unnest(string_split(w.a, '')) as x, generate_subscripts(string_split(w.a, ''), 1) as o from e where w.a <> '') window q as (partition by c order by o)),
r as (select u.c, sha256(coalesce(string_agg(case when x = 'K' then role else case when (po - sys) % 2 = 0 then 'user' else 'assistant' end end || ':' || case when x = 'I' then '' else text end, chr(10) order by o) filter (x <> 'D'), '')) as h
  from u left join n on u.c = n.c and u.i = n.i group by u.c),
a as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from n group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(w.c, 0)::bigint as cost, coalesce(w.a, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id, coalesce(conv_id::varchar, 'null') as c from conversations) left join a using (c) left join e using (c) left join r using (c)
"""


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


_WORDS12 = rf"regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '{decontaminate.WORD}')"
OP12 = rf"""
with d as materialized (select row_number() over () as r, doc_id, {_WORDS12} as ws from documents),
b as (select coalesce(item_id::varchar, 'null') as item, {_WORDS12} as ws from benchmark),
v as materialized (select distinct item, least(len(ws), 10) as n, array_to_string(ws[i:i + 9], ' ') as w from (select *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
p as (select r, i, n, array_to_string(ws[i:i + n - 1], ' ') as w from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from v) where len(ws) >= n)),
o as materialized (select p.r, p.i, v.n, v.item from p join v on p.w = v.w and p.n = v.n),
h as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as at from o) group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from o) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join h using (r) left join t using (r)
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, rank=centroids.seeded_rank(2))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha256_hex(F.col("centroid")).alias("centroid_sha256"))


def _op13(k: int, rounds: int) -> str:
    """All distances in every round: |x|^2 - 2 x.c + |c|^2, exact in doubles."""
    near = "a{i} as materialized (select r, min({{'d': ee - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e), 'k': k}}) as m from v, c{i} c group by r)"
    mean = """s{i} as (select m.k as k, j, sum(x)::bigint as s, count(*) as n from (select r, generate_subscripts(e, 1) as j, unnest(e)::bigint as x from v) join a{i} using (r) group by all),
c{n} as materialized (select k, coalesce(f.e, c.e) as e from c{i} c left join (select k, list(((s - (s % n + n) % n) // n)::double order by j) as e from s{i} group by k) f using (k))"""
    steps = [near.format(i=i) + (",\n" + mean.format(i=i, n=i + 1) if i < rounds else "") for i in range(rounds + 1)]
    return f"""
with v as materialized (select *, list_inner_product(e, e) as ee from (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
c0 as materialized (select row_number() over (order by h, e) - 1 as k, e from (select e, sha256('2:' || coalesce(vec_id::varchar, 'null')) as h from v order by h, e limit {k})),
{', '.join(steps)},
z as (select vec_id, m.k as k, m.d::bigint as d from v join a{rounds} using (r))
select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(list_transform(c.e, lambda x: x::bigint), ',')) as centroid_sha256 from z join c{rounds} c using (k)
"""


OP13 = _op13(40, 5)

QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_toxicity": op2_toxicity, "op3_chat_format": op3_chat_format, "op4_secret_scan": op4_secret_scan, "op5_jaccard_join": op5_jaccard_join, "op6_pii": op6_pii, "op7_line_dedup": op7_line_dedup, "op8_sentencepiece": op8_sentencepiece, "op9_mix": op9_mix, "op10_exact_top_k": op10_exact_top_k, "op11_conversation_repair": op11_conversation_repair, "op12_decontaminate": op12_decontaminate, "op13_centroids": op13_centroids}
ORACLES = {"op1_quality_rules": OP1, "op3_chat_format": OP3, "op4_secret_scan": OP4, "op5_jaccard_join": OP5, "op7_line_dedup": OP7, "op9_mix": OP9, "op10_exact_top_k": OP10, "op11_conversation_repair": OP11, "op12_decontaminate": OP12, "op13_centroids": OP13}
