"""What the index derives from records and documents: hosts, cites, counts, reading and hosted order, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.functions import text
from argosy.operators import build
from argosy.operators.prefix import before
from argosy.plans.star import settle


def first_markers(markers: DataFrame) -> DataFrame:
    """id, path, line, offset: of an id's markers (path, id, line, offset) the first, by path and offset; it is the node's host."""
    least = markers.groupBy("id").agg(F.min(F.struct("path", "offset", "line")).alias("m"))
    return least.select("id", "m.path", "m.line", "m.offset")


def host_anchors(first: DataFrame, docs: DataFrame) -> DataFrame:
    """id, path, anchor: the heading's anchor at or above each first marker, "" where none stands above."""
    return build.hosted_under(first, text.headings_of(docs)).select("id", "path", "anchor")


def cites(nodes: DataFrame, markers: DataFrame) -> DataFrame:
    """claim, leaf: every document that holds a claim's marker, once."""
    claims = nodes.where("kind = 'claim'").select(F.col("id").alias("claim"))
    return markers.select(F.col("id").alias("claim"), F.col("path").alias("leaf")).distinct().join(claims, "claim", "left_semi")


def claim_counts(nodes: DataFrame, edges: DataFrame, cited: DataFrame) -> DataFrame:
    """id, premises (supports and founds edges in) and citations of every claim."""
    premises = edges.where(F.col("relation").isin("supports", "founds")).groupBy(F.col("target").alias("_t")).agg(F.count(F.lit(1)).alias("premises"))
    citations = cited.groupBy(F.col("claim").alias("_c")).agg(F.count(F.lit(1)).alias("citations"))
    joined = nodes.where("kind = 'claim'").select("id").join(premises, F.col("id") == F.col("_t"), "left").join(citations, F.col("id") == F.col("_c"), "left")
    return joined.select("id", F.coalesce("premises", F.lit(0)).alias("premises"), F.coalesce("citations", F.lit(0)).alias("citations"))


def volume_claims(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """volume, claims (distinct, by the leaves that cite them) and experiments (by host) of every volume (top folder)."""
    top = lambda c: F.substring_index(c, "/", 1)
    claims = cited.where(F.col("leaf").contains("/")).groupBy(top("leaf").alias("volume")).agg(F.count_distinct("claim").alias("claims"))
    runs = nodes.where("kind = 'experiment' and host like '%/%'").groupBy(top("host").alias("volume")).agg(F.count(F.lit(1)).alias("experiments"))
    return claims.join(runs, "volume", "full_outer").select("volume", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("experiments", F.lit(0)).alias("experiments"))


def child_lists(docs: DataFrame) -> DataFrame:
    """parent, position (from 0), child of every document's child list."""
    from argosy.functions import markdown

    listed = text.udf(lambda x: markdown.child_list(*x.split("\0", 1)), "array<string>")(F.concat_ws("\0", "path", "text"))
    return docs.select(F.col("path").alias("parent"), F.posexplode(listed).alias("position", "child"))


def up_links(docs: DataFrame) -> DataFrame:
    """child, parent: the document that a document's first link of its own line leads up to."""
    from argosy.functions import markdown

    up = text.udf(lambda x: markdown.up_link(*x.split("\0", 1)), "string")(F.concat_ws("\0", "path", "text"))
    return docs.select(F.col("path").alias("child"), up.alias("parent")).where("parent is not null")


def reading_positions(children: DataFrame, entry: str) -> DataFrame:
    """path, position (from 0): the documents reached from the entry in pre-order over child lists (parent, position, child); the first visit wins."""
    return before(reading_keys(children, entry).select("path", "key"), [F.col("key")], {"position": 1}).select("path", "position")


def reading_keys(children: DataFrame, entry: str) -> DataFrame:
    """path, key (positions in the lists that lead to it from the entry), trail (the documents on the way, itself last) of all that is reached; keys sort in pre-order.

    A document is visited where the path of positions that leads to it without a repeat is least, so levels are joined until no least path changes.
    """
    held = settle(children.select("parent", F.col("position").cast("int").alias("at"), "child"))
    front = settle(held.sparkSession.createDataFrame([(entry, [], [entry])], "path string, key array<int>, trail array<string>"))
    best = front
    while front.limit(1).count():
        step = front.join(held, F.col("path") == F.col("parent")).where(~F.array_contains("trail", F.col("child")))
        step = step.select(F.col("child").alias("path"), F.concat("key", F.array("at")).alias("key"), F.concat("trail", F.array("child")).alias("trail"))
        found = step.groupBy("path").agg(F.min(F.struct("key", "trail")).alias("n")).select("path", "n.key", "n.trail")
        old = best.select(F.col("path").alias("_p"), F.col("key").alias("_k"))
        front = settle(found.join(old, F.col("path") == F.col("_p"), "left").where("_k is null or key < _k").select("path", "key", "trail"))
        best = settle(best.join(front.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti").unionByName(front))
    return best


def hosted_order(first: DataFrame, positions: DataFrame) -> DataFrame:
    """id, rank (from 0): hosted ids by their host's place in reading order, hosts that it misses last by path, then offset, then id."""
    placed = first.join(positions.select(F.col("path").alias("_p"), "position"), F.col("path") == F.col("_p"), "left")
    return before(placed.select("id", "path", "offset", "position"), [F.col("position").asc_nulls_last(), F.col("path"), F.col("offset"), F.col("id")], {"rank": 1}).select("id", "rank")


def sequence(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """id, seq (from 0): every node, hosted ones first in their order (id, rank), the others by id."""
    placed = nodes.select("id").distinct().join(order.select(F.col("id").alias("_i"), F.col("rank").alias("_r")), F.col("id") == F.col("_i"), "left")
    return before(placed.select("id", "_r"), [F.col("_r").asc_nulls_last(), F.col("id")], {"seq": 1}).select("id", "seq")


def index_edges(edges: DataFrame) -> DataFrame:
    """relation, source, target, context, rank (from 0): edges as the index lists them, by source, target and context."""
    rows = edges.select("relation", "replaced_relation", "source", "target", "context")
    order = [F.col("source"), F.col("target"), F.coalesce("context", F.lit("")), F.col("relation"), F.coalesce("replaced_relation", F.lit(""))]
    return before(rows, order, {"rank": 1}).select("relation", "source", "target", "context", "rank")


def localities(edges: DataFrame, first: DataFrame) -> DataFrame:
    """source, target, locality of edges between hosted nodes: same document, directory or paper (top folder), or across papers."""
    held = first.select("id", "path")
    joined = edges.select("source", "target").join(held.select(F.col("id").alias("source"), F.col("path").alias("_a")), "source").join(held.select(F.col("id").alias("target"), F.col("path").alias("_b")), "target")
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    top = lambda c: F.substring_index(c, "/", 1)
    near = F.when(F.col("_a") == F.col("_b"), "document").when(folder("_a") == folder("_b"), "directory").when(top("_a") == top("_b"), "paper").otherwise("cross")
    return joined.select("source", "target", near.alias("locality"))
