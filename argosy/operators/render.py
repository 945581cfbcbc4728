"""Rendering: record files, summary pages, DOT sheets, reference footers. Every line is a row; parts of a file are put together by aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions import text as T
from argosy.functions.graph import band, display, relation_rank, scoring
from argosy.operators.graph import transitive_reduction
from argosy.operators.prefix import ROW_BITS, before, dealt_in_order
from argosy.operators.strength import trace_text
from argosy.plans.star import settle, stored

STROKES = {"supports": "solid", "founds": "bold", "lifts": "dashed", "refutes": "dotted", "demoted": "dotted constraint=false"}


def quoted(x: Column) -> Column:
    """A text in quotes with JSON's escapes, so that it stays on one line whatever it holds; null stays null."""
    made = F.to_json(F.struct(x.cast("string").alias("x")))
    text = F.substring(made, F.lit(6), F.length(made) - 6)
    for sign in "\x7f\x85\u2028\u2029":  # line breaks and controls that JSON leaves as they are
        text = F.replace(text, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.when(x.isNotNull(), text)


def number(x: Column) -> Column:
    """A number as records spell it: Python's shortest form that reads back; null stays null."""
    return F.when(x.isNotNull(), T.udf(lambda v: repr(float(v)), "string")(x))


def parts(df: DataFrame, by: str, order: Sequence[Column], line: Column, name: str, size: int = 1000) -> DataFrame:
    """`by`, part (from 0) and text: each file's lines in order, `size` lines to a part. A file's parts joined by newlines are its text.

    Lines are dealt to range partitions once and stored in order without what they are ordered by. A place is the row's within its partition, beyond
    the file's lines in those before, so a file of any size is put together in many tasks. `line` as a last order column is dealt once.
    """
    names = ["_line" if o is line else f"_o{i}" for i, o in enumerate(order)]
    keyed = df.select(by, *[o.alias(n) for o, n in zip(order, names, strict=True) if n != "_line"], line.alias("_line"))
    dealt = dealt_in_order(keyed, [F.col(by), *map(F.col, names)], by, "_line").withColumn("_part", F.shiftright("_row", ROW_BITS))
    runs = dealt.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.min("_row").alias("_low"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.select("_by", "_of", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_low")).alias("_shift")))  # a row for each partition and file
    placed = dealt.join(runs, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of"))).withColumn("part", F.floor((F.col("_row") + F.col("_shift")) / size).cast("int"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_row", "_line"))), lambda s: s["_line"]), "\n")
    return placed.groupBy(by, "part").agg(texts.alias(name))


def write_files(texts: DataFrame, folder: str, path: str = "path", text: str = "text") -> None:
    """Every file's parts below `folder`/path=..., in order: the files of one folder, concatenated by name, are the file."""
    texts.repartitionByRange(F.col(path), F.col("part")).sortWithinPartitions(path, "part").select(path, text).write.mode("overwrite").partitionBy(path).text(folder)


#: A page's lists by the relations they hold, and whose entry an edge stands on: a reference on its source's, all others on their target's.
LISTS = {"supports": ("rests-on", 7), "founds": ("rests-on", 7), "lifts": ("lifted-by", 9), "refutes": ("refuted-by", 11), "references": ("references", 13), "demoted": ("demoted", 15)}


def listed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, sec, list, line, order columns of every bullet of an entry's lists."""
    on_source = F.col("relation") == "references"
    name, sec = (F.element_at(F.create_map(*[x for r, v in LISTS.items() for x in (F.lit(r), F.lit(v[i]))]), F.col("relation")) for i in (0, 1))
    routed = edges.select("*", F.when(on_source, F.col("source")).otherwise(F.col("target")).alias("id"), F.when(on_source, F.col("target")).otherwise(F.col("source")).alias("other"), name.alias("list"), sec.alias("sec"))
    far = nodes.select(F.col("id").alias("_o"), F.col("title").alias("_title"), F.when(F.col("kind").isin("claim", "analysis"), display(F.col("strength"))).alias("_shown"))
    bearing = F.when(F.col("bearing_pending"), F.lit("pending")).otherwise(number(F.col("bearing")))
    bit = lambda before, x, after: F.coalesce(F.concat(F.lit(before), x, F.lit(after)), F.lit(""))
    line = F.concat(
        F.lit("  - "), "other", bit(" — ", F.col("_title"), ""), bit(" (", F.when(scoring(F.col("relation")), F.col("_shown")), ")"), bit(" (demoted from ", F.col("replaced_relation"), ")"),
        bit(" [", bearing, "]"), bit(" [", F.when(F.col("context") != "", F.col("context")), "]"),
    )
    return routed.join(far, F.col("other") == F.col("_o"), "left").select("id", F.col("sec") + 1, "list", line.alias("line"), relation_rank(F.col("relation")).alias("r"), "other").toDF("id", "sec", "list", "line", "r", "other")


def page_lines(nodes: DataFrame, edges: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """path, place (order of the entry), id, sec, r, other, line: every line of the summary pages.

    A volume's page holds its hosted nodes by host and id, works.md the works by label. `leaves` (id, leaf): documents that name a node.
    """
    held = nodes.where("host is not null or kind = 'work'").select("*", F.when(F.col("kind") == "work", "works.md").otherwise(F.concat(F.substring_index("host", "/", 1), F.lit("/summary.md"))).alias("path"))
    place = F.struct(F.coalesce("host", "label", F.lit("")).alias("at"), F.col("id").alias("by"))
    derived = F.col("kind").isin("claim", "analysis")
    named = held.select("id", F.lit("").alias("leaf")).limit(0) if leaves is None else leaves.select("id", "leaf")
    footer = named.groupBy(F.col("id").alias("_f")).agg(F.array_join(F.sort_array(F.collect_set("leaf")), ", ").alias("_leaves"))
    traced = trace_text(nodes).select(F.col("id").alias("_tr"), "trace")
    full = held.join(footer, F.col("id") == F.col("_f"), "left").join(traced, F.col("id") == F.col("_tr"), "left")
    rows = F.array(*[
        F.struct(F.lit(sec).alias("sec"), text.alias("line"))
        for sec, text in (
            (0, F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit(" <!-- node-id: "), "id", F.lit(" -->"))),
            (1, F.lit("")),
            (2, F.when(F.col("kind") != "work", F.concat(F.lit("Leaves: "), F.coalesce("_leaves", F.lit("none"))))),
            (3, F.when(F.col("kind") != "work", F.lit(""))),
            (4, F.lit("### Rigor")),
            (5, F.when(F.col("kind") == "experiment", F.concat(F.lit("- status: "), "status"))),
            (6, F.concat(F.lit("- rigor: "), F.coalesce(number(F.col("rigor")), F.lit("pending")), F.when(F.col("manually_scored"), F.lit(" (manual)")).otherwise(""))),
            (18, F.when(derived, F.lit(""))),
            (19, F.when(derived, F.lit("### Strength"))),
            (20, F.when(derived, F.concat(display(F.col("strength")), F.when(F.col("trace") != "", F.concat(F.lit(" [= "), "trace", F.lit("]"))).otherwise("")))),
            (21, F.lit("")),
        )
    ])
    own = full.select("path", place.alias("place"), "id", F.explode(F.filter(rows, lambda x: x["line"].isNotNull())).alias("x")).select("path", "place", "id", "x.sec", F.lit(-1).alias("r"), F.lit("").alias("other"), "x.line")
    items = stored(listed(nodes, edges))
    heads = items.select("id", (F.col("sec") - 1).alias("sec"), F.concat(F.lit("- "), "list", F.lit(":")).alias("line")).distinct().select("id", "sec", F.lit(-1).alias("r"), F.lit("").alias("other"), "line")
    at = held.where(derived).select(F.col("id").alias("_i"), "path", place.alias("place"))
    lists = items.select("id", "sec", "r", "other", "line").unionByName(heads).join(at, F.col("id") == F.col("_i")).select("path", "place", "id", "sec", "r", "other", "line")
    return own.unionByName(lists)


def pages(nodes: DataFrame, edges: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """path, part, text of the summary pages."""
    lines = page_lines(nodes, edges, leaves)
    line = F.col("line")
    return parts(lines, "path", [F.col("place"), F.col("sec"), F.col("r"), F.col("other"), line], line, "text")


def page_anchors(headings: DataFrame) -> DataFrame:
    """page, at, anchor of a page's headings (page, at: a total order, heading); a repeated slug takes the first free number.

    Numbers count a slug's headings by running sums; only pages where a numbered anchor is also a heading of its own go through the slugger whole.
    """
    slugged = settle(headings.select("page", "at", "heading", T.udf(T.slug, "string")(F.concat(F.lit("# "), "heading")).alias("slug")))
    ranked = before(slugged, [F.col("page"), F.col("slug"), F.col("at")], {"_rank": 1})
    first = ranked.groupBy(F.col("page").alias("_p"), F.col("slug").alias("_s")).agg(F.min("_rank").alias("_first"))
    numbered = settle(ranked.join(first, (F.col("page") == F.col("_p")) & (F.col("slug") == F.col("_s"))).select("page", "at", "heading", "slug", (F.col("_rank") - F.col("_first")).alias("n")))
    anchor = F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n"))
    taken = numbered.where("n > 0").select("page", anchor.alias("slug")).join(slugged.select("page", "slug").distinct(), ["page", "slug"], "left_semi").select(F.col("page").alias("_odd")).distinct()

    def whole(page):
        page = page.sort_values("at")
        return page.assign(anchor=T.slugs(["# " + h for h in page["heading"]]))[["page", "at", "anchor"]]

    kind = dict(slugged.dtypes)
    odd = slugged.join(taken, F.col("page") == F.col("_odd"), "left_semi").groupBy("page").applyInPandas(whole, f"page string, at {kind['at']}, anchor string")
    return numbered.join(taken, F.col("page") == F.col("_odd"), "left_anti").select("page", "at", anchor.alias("anchor")).unionByName(odd)


def _node_line(n: str = "id") -> Column:
    return F.concat(F.lit("  "), quoted(F.col(n)), F.lit(" [label="), quoted(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), display(F.col("strength")))), F.lit("];"))


def _drawn_rows(nodes: DataFrame, edges: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(volume, id) of every node or ghost and (volume, relation, source, target) of every stroke of every sheet, reduced. `whole`: the full sheet, its volume empty, in place of the volumes'."""
    group = F.when(F.col("host").contains("/"), F.substring_index("host", "/", 1)).otherwise("")
    held = nodes.select("id", (F.lit("") if whole else group).alias("volume"))
    drawn = edges.where(F.col("relation").isin(*STROKES)).select("relation", "source", "target").distinct()
    if whole:
        own, touch = held, drawn.withColumn("volume", F.lit(""))
    else:
        own = held.where("volume <> ''")
        # A stroke meets the volumes of both its ends in one row, so its sheets need no distinct.
        drawn, by_id = stored(drawn), own.groupBy("id").agg(F.collect_set("volume").alias("_v"))
        for end in ("source", "target"):
            drawn = drawn.join(by_id.select(F.col("id").alias(end), F.col("_v").alias(f"_{end}")), end, "left")
        none = F.array().cast("array<string>")
        touch = drawn.select("relation", "source", "target", F.explode(F.array_union(F.coalesce("_source", none), F.coalesce("_target", none))).alias("volume"))
    touch = stored(touch)
    ends = touch.select("volume", F.col("source").alias("id")).union(touch.select("volume", F.col("target"))).distinct()
    return stored(ends.unionByName(own.select("volume", "id")).distinct()), transitive_reduction(touch, "volume")


def _drawn(nodes: DataFrame, edges: DataFrame, whole: bool) -> DataFrame:
    """volume, k, a, b, c, line of every sheet: nodes (k 0), ghosts (1), strokes (2)."""
    shown, kept = _drawn_rows(nodes, edges, whole)
    strokes = F.create_map(*[F.lit(x) for kv in STROKES.items() for x in kv])
    named = shown.join(nodes.select("id", "title", "strength", F.lit(True).alias("_held")), "id", "left")
    ghost = F.concat(F.lit("  "), quoted(F.col("id")), F.lit(' [style="dashed" label='), quoted(F.col("id")), F.lit("];"))
    return named.select("volume", F.when(F.col("_held"), 0).otherwise(1).alias("k"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.when(F.col("_held"), _node_line()).otherwise(ghost).alias("line")).unionByName(
        kept.select("volume", F.lit(2).alias("k"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("c"), F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(" [style="), F.element_at(strokes, F.col("relation")), F.lit("];")).alias("line"))
    )


def _sheets(lines: DataFrame) -> DataFrame:
    """volume, part, dot: each sheet's lines in order between its first and last."""
    ends = lines.select("volume").distinct().select("volume", F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.lit("digraph claims {").alias("line")), F.struct(F.lit(9).alias("k"), F.lit("}").alias("line")))).alias("x"))
    ends = ends.select("volume", "x.k", F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), "x.line")
    return parts(lines.unionByName(ends), "volume", [F.col(c) for c in ("k", "a", "b", "c")], F.col("line"), "dot")


def legend(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """volume, item (kind, band or stroke), name, n: what a volume's sheet draws, and how often; ghosts are a kind."""
    shown, strokes = _drawn_rows(nodes, edges, False)
    named = shown.join(nodes.select(F.col("id").alias("_id"), "kind", band(F.col("strength")).alias("band")), F.col("id") == F.col("_id"), "left")
    kinds = named.groupBy("volume", F.coalesce("kind", F.lit("ghost")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select("volume", F.lit("kind").alias("item"), "name", "n")
    bands = named.where("band is not null").groupBy("volume", F.col("band").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("volume", F.lit("band").alias("item"), "name", "n")
    counts = strokes.groupBy("volume", F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("volume", F.lit("stroke").alias("item"), "name", "n")
    return kinds.unionByName(bands).unionByName(counts)


def digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """tail, head, premise, words: the edges between two volumes, premises (supports, founds) apart, as counts in listing order ("3 supports · 1 lifts")."""
    volume = nodes.where("host is not null").select(F.col("id").alias("_id"), F.substring_index("host", "/", 1).alias("_v"))
    drawn = edges.where(F.col("relation").isin(*STROKES)).select("relation", "source", "target").distinct()
    joined = drawn.join(volume.withColumnsRenamed({"_id": "_s", "_v": "tail"}), F.col("source") == F.col("_s")).join(volume.withColumnsRenamed({"_id": "_t", "_v": "head"}), F.col("target") == F.col("_t")).where("tail <> head")
    counts = joined.groupBy("tail", "head", F.col("relation").isin("supports", "founds").alias("premise"), "relation").agg(F.count(F.lit(1)).alias("n"))
    item = F.struct(relation_rank(F.col("relation")).alias("r"), F.concat_ws(" ", "n", "relation").alias("w"))
    return counts.groupBy("tail", "head", "premise").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["w"]), " · ").alias("words"))


def sheet(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """volume, part, dot: each volume's nodes, those one edge away, ids that no record carries (ghosts), and the strokes with an end in the volume, one for each (source, target, relation), less the supports edges that others of the sheet make needless."""
    return _sheets(_drawn(nodes, edges, False))


def full_sheet(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """volume (empty), part, dot: all nodes, those without host too, ghosts and strokes, reduced."""
    return _sheets(_drawn(nodes, edges, True))


#: A record's fields in order.
RECORD = {
    "claim": ("id", "title", "rigor", "manually-scored", "rationale", "judged-hash"), "analysis": ("id", "title", "rigor", "manually-scored", "rationale", "judged-hash"),
    "experiment": ("id", "title", "status", "rigor", "manually-scored", "judged-hash"), "work": ("id", "label", "title", "rigor", "rationale"), "axiom": ("id", "label", "title"),
}
_SCORED = ("relation", "source", "target", "context", "bearing", "manually-scored", "judged-hash")
EDGE = {
    "references": ("relation", "source", "target", "context"), "demoted": ("relation", "replaced-relation", "source", "target", "context", "bearing", "manually-scored"), "founds": ("relation", "source", "target", "context", "bearing"),
    "supports": _SCORED, "lifts": _SCORED, "refutes": _SCORED,
}
NEVER_JUDGED = "0" * 64


def _field(df: DataFrame, name: str, first: bool) -> Column:
    """One field's line: numbers as they read back, pending by its word, texts quoted; what a record lacks as its empty value."""
    column = name.replace("-", "_")
    held = F.col(column) if column in df.columns else F.lit(None).cast("string")
    if name in ("rigor", "bearing"):
        value = F.coalesce(number(held.cast("double")), F.lit('"*pending*"'))
    elif name == "manually-scored":
        value = F.coalesce(held.cast("boolean"), F.lit(False)).cast("string")
    elif name in ("id", "source", "target", "relation", "replaced-relation", "status"):
        value = F.coalesce(held, F.lit(""))
    else:
        value = quoted(F.coalesce(held.cast("string"), F.lit(NEVER_JUDGED if name == "judged-hash" else "")))
    return F.concat(F.lit("- " if first else "  "), F.lit(f"{name}: "), value)


def _record(df: DataFrame, by: str, kinds: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for kind, fields in kinds.items():
        text = F.concat_ws("\n", *[_field(df, f, i == 0) for i, f in enumerate(fields)])
        out = F.when(F.col(by) == kind, text) if out is None else out.when(F.col(by) == kind, text)
    return out


def record_file(nodes: DataFrame) -> DataFrame:
    """kind, part, text: nodes as a YAML list in id order, with every field of their kind."""
    entry = _record(nodes, "kind", RECORD)
    return parts(nodes, "kind", [F.col("id"), entry], entry, "text")


def changed_files(wanted: DataFrame, standing: DataFrame) -> DataFrame:
    """path, action of files to write or remove: only those whose bytes differ."""
    both = wanted.select(F.col("path").alias("w"), F.sha2("text", 256).alias("wh")).join(standing.select(F.col("path").alias("s"), F.sha2("text", 256).alias("sh")), F.col("w") == F.col("s"), "full_outer")
    return both.where(~F.col("wh").eqNullSafe(F.col("sh"))).select(F.coalesce("w", "s").alias("path"), F.when(F.col("w").isNull(), "remove").otherwise("write").alias("action"))


def footers(links: DataFrame) -> DataFrame:
    """id, leaves: the documents whose links (path, link.title) name a node."""
    return links.where("link.title rlike '^(clm|exp|ana|wrk|axm)-'").groupBy(F.col("link.title").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("path")), ", ").alias("leaves"))


def edge_file(edges: DataFrame) -> DataFrame:
    """relation, part, text: edges as a YAML list in identity order, with every field of their relation."""
    entry = _record(edges, "relation", EDGE)
    return parts(edges, "relation", [F.coalesce(relation_rank(F.col("replaced_relation")), F.lit(-1)), F.col("source"), F.col("target"), entry], entry, "text")


def volume_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """volume, nodes of each kind, those without an edge, and inner edges."""
    own = nodes.where("host is not null").select(F.substring_index("host", "/", 1).alias("volume"), "id", "kind")
    used = edges.select(F.col("source").alias("_u")).union(edges.select("target")).distinct()
    counted = own.join(used, F.col("id") == F.col("_u"), "left").groupBy("volume").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("claim", "analysis", "experiment")], F.count_if(F.col("_u").isNull()).alias("unattached"))
    ends = own.select(F.col("id").alias("_id"), F.col("volume").alias("_v"))
    inner = edges.join(ends.withColumnsRenamed({"_id": "_s", "_v": "_sv"}), F.col("source") == F.col("_s")).join(ends.withColumnsRenamed({"_id": "_t", "_v": "_tv"}), F.col("target") == F.col("_t")).where("_sv = _tv").groupBy(F.col("_sv").alias("_w")).agg(F.count(F.lit(1)).alias("inner"))
    return counted.join(inner, F.col("volume") == F.col("_w"), "left").drop("_w").fillna(0, ["inner"])
