"""Integrity: one DataFrame for each class of fault, all of the shape (check, subject, detail), and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosy.functions import text
from argosy.functions.graph import BEARING_TARGETS, ID, bearing_legal, id_kind


def fault(df: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.alias("subject"), detail.alias("detail"))


def edge_name() -> Column:
    return F.concat_ws(" ", "relation", "source", "target")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An edge end that no node carries; one fault for each missing end."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    ends = edges.select("*", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source").alias("id")), F.struct(F.lit("target").alias("end"), F.col("target").alias("id")))).alias("e"))
    return fault(ends.join(ids, F.col("e.id") == F.col("_id"), "left_anti"), "dangling", edge_name(), F.concat_ws(" ", "e.end", "e.id"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    again = edges.groupBy("relation", "replaced_relation", "source", "target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return fault(again, "duplicate edge", edge_name(), F.col("n").cast("string"))


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return fault(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate node", F.col("id"), F.col("n").cast("string"))


def illegal_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A bearing where relation and kinds allow none. Kinds come from the ids' nodes."""
    kinds = nodes.select("id", "kind")
    joined = edges.join(kinds.select(F.col("id").alias("_s"), F.col("kind").alias("sk")), F.col("source") == F.col("_s")).join(kinds.select(F.col("id").alias("_t"), F.col("kind").alias("tk")), F.col("target") == F.col("_t"))
    named = F.when(F.col("relation") == "demoted", F.col("replaced_relation")).otherwise(F.col("relation"))
    carries = F.col("bearing").isNotNull() | F.coalesce("bearing_pending", F.lit(False))
    return fault(joined.where(carries & ~bearing_legal(named, F.col("sk"), F.col("tk"))), "illegal pairing", edge_name(), F.concat_ws(" ", "sk", "tk"))


def domains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers outside [0, 1], ids outside the grammar, kinds that their id denies."""
    odd = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1))
    return reduce(DataFrame.unionByName, [
        fault(nodes.where(odd("rigor")), "rigor outside [0, 1]", F.col("id"), F.col("rigor").cast("string")),
        fault(edges.where(odd("bearing")), "bearing outside [0, 1]", edge_name(), F.col("bearing").cast("string")),
        fault(nodes.where(~F.col("id").rlike(ID)), "bad id", F.col("id"), F.col("kind")),
        fault(nodes.where(id_kind(F.col("id")) != F.col("kind")), "kind denied by id", F.col("id"), F.col("kind")),
    ])


def marker_faults(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Hosted kinds need exactly one statement marker."""
    counts = text.markers_of(docs).groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    hosted = nodes.where(F.col("kind").isin("claim", "analysis", "experiment")).join(counts, F.col("id") == F.col("_id"), "left")
    return fault(hosted.where(F.coalesce("n", F.lit(0)) != 1), "marker cardinality", F.col("id"), F.coalesce("n", F.lit(0)).cast("string"))


def unknown_ids(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids in prose that no node carries."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    return fault(text.bare_ids_of(docs).join(ids, F.col("id") == F.col("_id"), "left_anti"), "unknown id", F.concat_ws(":", "path", "line"), F.col("id"))


def bare_known_ids(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids in prose that a node carries and that should be citations."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    return fault(text.bare_ids_of(docs).join(ids, F.col("id") == F.col("_id"), "left_semi"), "bare id", F.concat_ws(":", "path", "line"), F.col("id"))


def dead_links(docs: DataFrame) -> DataFrame:
    """Links to a path that isn't there, or to an anchor that its document lacks."""
    to = text.udf(lambda x: "#".join(text.resolved(*x.split("\0", 1))), "string")
    found = text.links_of(docs).withColumn("_to", to(F.concat_ws("\0", "path", "link.destination")))
    parts = found.withColumn("_path", F.substring_index("_to", "#", 1)).withColumn("_anchor", F.substring_index("_to", "#", -1)).where(F.col("_path") != "")
    paths, anchors = docs.select(F.col("path").alias("_p")).distinct(), text.headings_of(docs).select(F.col("path").alias("_p"), F.col("anchor").alias("_a")).distinct()
    no_path = fault(parts.join(paths, F.col("_path") == F.col("_p"), "left_anti"), "dead link", F.concat_ws(":", "path", "line"), F.col("link.destination"))
    to_anchor = parts.where(F.col("_anchor") != "").join(paths, F.col("_path") == F.col("_p"), "left_semi")
    return no_path.unionByName(fault(to_anchor.join(anchors, (F.col("_path") == F.col("_p")) & (F.col("_anchor") == F.col("_a")), "left_anti"), "dead fragment", F.concat_ws(":", "path", "line"), F.col("link.destination")))


def axiom_headings(axioms: DataFrame, headings: DataFrame) -> DataFrame:
    """Axiom records (id, label, title) against marked headings (id, heading): none, many, other text, unknown id."""
    marked = headings.groupBy(F.col("id").alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.min("heading").alias("heading"))
    joined = axioms.join(marked, F.col("id") == F.col("_h"), "full_outer")
    what = F.when(F.col("id").isNull(), "unknown id").when(F.col("_h").isNull(), "no heading").when(F.col("n") > 1, "several headings").when(F.col("heading") != F.concat_ws(" ", "label", "title"), "other text")
    return fault(joined.where(what.isNotNull()), "axiom heading", F.coalesce("id", "_h"), what)


def set_equality(left: DataFrame, right: DataFrame, check: str) -> DataFrame:
    """Rows (name) that one side has and the other lacks."""
    a, b = left.select("name").distinct(), right.select("name").distinct()
    return fault(a.exceptAll(b), check, F.col("name"), F.lit("only left")).unionByName(fault(b.exceptAll(a), check, F.col("name"), F.lit("only right")))


def unreached(links: DataFrame, entry: str, docs: DataFrame) -> DataFrame:
    """Documents (path) that no chain of child links (parent, child) reaches from the entry point."""
    from argosy.operators.graph import closure

    start = docs.sparkSession.createDataFrame([(entry,)], "id string")
    reached = closure(links.select(F.col("parent").alias("source"), F.col("child").alias("target")), start).select(F.col("node").alias("path"))
    return fault(docs.join(reached, "path", "left_anti"), "unreached", F.col("path"), F.lit(entry))


def stale_pages(wanted: DataFrame, standing: DataFrame) -> DataFrame:
    """Pages (path, text) missing, extra, or with other bytes."""
    joined = wanted.select(F.col("path").alias("wp"), F.sha2("text", 256).alias("wh")).join(standing.select(F.col("path").alias("sp"), F.sha2("text", 256).alias("sh")), F.col("wp") == F.col("sp"), "full_outer")
    what = F.when(F.col("sp").isNull(), "missing").when(F.col("wp").isNull(), "extra").when(~F.col("wh").eqNullSafe(F.col("sh")), "stale")
    return fault(joined.where(what.isNotNull()), "page", F.coalesce("wp", "sp"), what)


def inverse_links(up: DataFrame, down: DataFrame) -> DataFrame:
    """Up-links (child, parent) and child lists (parent, child) have to be each other's inverse."""
    a, b = up.select("child", "parent"), down.select("child", "parent")
    return fault(a.exceptAll(b), "not in child list", F.col("child"), F.col("parent")).unionByName(fault(b.exceptAll(a), "no up-link", F.col("child"), F.col("parent")))


def frontmatter(docs: DataFrame) -> DataFrame:
    """Documents that open with a frontmatter block: none carries one."""
    return fault(docs.where(F.col("text").rlike(r"(?s)\A---[ \t]*\n(?:.*?\n)?---[ \t]*(?:\n|\z)")), "frontmatter", F.concat("path", F.lit(":1")), F.lit(""))


def demoted(edges: DataFrame) -> DataFrame:
    """Edges that breaking cycles demoted: reported, not a fault."""
    return fault(edges.where("relation = 'demoted'"), "demoted", F.concat_ws(" ", "source", "target"), F.col("replaced_relation"))


def verify(nodes: DataFrame, edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """All faults of records, and of documents if they are given."""
    found = [dangling(nodes, edges), duplicate_edges(edges), duplicate_nodes(nodes), illegal_pairs(nodes, edges), domains(nodes, edges)]
    if docs is not None:
        found += [marker_faults(nodes, docs), unknown_ids(nodes, docs), bare_known_ids(nodes, docs), dead_links(docs), frontmatter(docs)]
    return reduce(DataFrame.unionByName, found)


def report(nodes: DataFrame, edges: DataFrame, docs: DataFrame, axioms: DataFrame, headings: DataFrame, wanted: DataFrame, standing: DataFrame) -> DataFrame:
    """The whole report: every fault of records and documents, axiom records against marked headings, pages against what they should be, and the demoted edges."""
    return reduce(DataFrame.unionByName, [verify(nodes, edges, docs), axiom_headings(axioms, headings), stale_pages(wanted, standing), demoted(edges)])


__all__ = ["BEARING_TARGETS", "dangling", "dead_links", "domains", "duplicate_edges", "duplicate_nodes", "illegal_pairs", "inverse_links", "marker_faults", "stale_pages", "unknown_ids", "verify"]
