"""The walk of a tree of documents by volumes: what is walked and where it stands, with numbers, intervals, labels and findings, as tables.

The entry lists the volumes' indexes; an index lists documents, and an index among them lists more. A document is walked where it is first named;
the walk is found by joining child lists level by level (`derive.reading_keys`). Every document's trail of ancestors then gives all the
rest without another walk: the ancestors' places among their walked siblings make its number (1.2.3), and the number of documents below it
closes its interval of positions (an Euler tour: b lies below a if b's position is in a's interval).

Defined results: volumes whose directories lie in one another are refused; documents that nothing names are left out; labels that two documents would share go to
the first in the walk, the later ones have none; leaves of references are skipped; empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosy.operators import derive
from argosy.operators.prefix import before
from argosy.plans.star import settle

# Names of indexes and of the leaf that holds a list of references.
INDEX, REFERENCES = "index.md", "references.md"


class Walk(NamedTuple):
    """volumes: volume (number), path, directory, label. documents: path, volume, rank (depth below the volume's index), number, first, last (interval of positions), label. findings: check, subject, detail."""

    volumes: DataFrame
    documents: DataFrame
    findings: DataFrame


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """A path's directories, from the top on."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def path_slug(path: Column) -> Column:
    """Letters and digits in lower case, all between them one hyphen, without the extension."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(path, r"\.[^./]*$", "")), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def ordinals(df: DataFrame, by: str, *order: str) -> DataFrame:
    """`df` with ordinal (from 1) among the rows of one `by`, in order; a group of any size is numbered across tasks."""
    ranked = before(df, [F.col(by), *map(F.col, order)], {"_rank": 1})
    first = ranked.groupBy(F.col(by).alias("_by")).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, F.col(by).eqNullSafe(F.col("_by"))).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_rank") - F.col("_first") + 1).alias("ordinal"))


def walk(children: DataFrame, files: DataFrame, entry: str) -> Walk:
    """The walk from `entry` over child lists (parent, position, child) of the documents that exist (path)."""
    held = settle(children.select("parent", F.col("position").cast("int").alias("position"), "child"))
    there = settle(files.select(F.col("path").alias("_file")).distinct())
    named = held.where((F.col("parent") == entry) & (base(F.col("child")) == INDEX))
    first = named.groupBy("child").agg(F.min("position").alias("position"))
    standing = first.join(there, F.col("child") == F.col("_file"), "left_semi")
    numbered = ordinals(standing.withColumn("_all", F.lit(0)), "_all", "position").select(F.col("ordinal").cast("int").alias("volume"), F.col("child").alias("path"), directory(F.col("child")).alias("directory"))
    volumes = settle(numbered.withColumn("label", F.concat(F.lit("vol"), F.col("volume").cast("string"))))
    inside = volumes.select(F.explode(ancestors(F.col("directory"))).alias("directory"), F.col("directory").alias("_own")).where("directory <> _own")
    if inside.join(volumes, "directory", "left_semi").limit(1).count() or volumes.groupBy("directory").count().where("count > 1").limit(1).count():
        raise ValueError("volumes lie in one another")
    finding = lambda df, check, detail: df.select(F.lit(check).alias("check"), F.col("parent").alias("subject"), detail.alias("detail"))
    again = named.join(first.withColumnRenamed("child", "_c").withColumnRenamed("position", "_p"), (F.col("child") == F.col("_c")) & (F.col("position") > F.col("_p")))
    findings = [finding(again, "volume again", F.col("child")), finding(first.withColumn("parent", F.lit(entry)).join(there, F.col("child") == F.col("_file"), "left_anti"), "no such volume", F.col("child"))]
    # Which volume an index and a child belong to, by the directories above them.
    of = lambda df, c, name: df.join(df.select(F.col(c).alias("_p")).distinct().select("_p", F.explode(ancestors(F.col("_p"))).alias("_d")).join(volumes.select(F.col("directory").alias("_d"), F.col("volume").alias(name)), "_d").drop("_d"), F.col(c) == F.col("_p"), "left").drop("_p")
    lists = held.where((F.col("parent") != entry) & (base(F.col("parent")) == INDEX) & (base(F.col("child")) != REFERENCES))
    placed = settle(of(of(lists, "parent", "_v"), "child", "_w").where("_v is not null").join(there, F.col("child") == F.col("_file"), "left"))
    legal = placed.where("_v = _w and _file is not null").select("parent", "position", "child")
    starts = volumes.select(F.lit(entry).alias("parent"), F.col("volume").alias("position"), F.col("path").alias("child"))
    keys = settle(derive.reading_keys(starts.unionByName(legal), entry).where(F.size("key") > 0))
    keys = keys.withColumn("parent", F.element_at("trail", -2)).withColumn("at", F.element_at("key", -1))
    walked = placed.join(keys.select(F.col("path").alias("_wp")), F.col("parent") == F.col("_wp"), "left_semi")
    findings += [
        finding(walked.where("_w is null or _w <> _v"), "outside its volume", F.col("child")), finding(walked.where("_w = _v and _file is null"), "no such document", F.col("child")),
        finding(walked.where("_w = _v and _file is not null").join(keys.select(F.col("path").alias("_c"), F.col("parent").alias("_pp"), F.col("at").alias("_a")), (F.col("child") == F.col("_c")) & (F.col("parent") == F.col("_pp")) & (F.col("position") == F.col("_a")), "left_anti"), "walked already", F.col("child")),
    ]
    among = ordinals(keys.select("path", "parent", "at"), "parent", "at").select(F.col("path").alias("_a"), "ordinal")
    spread = settle(keys.select("path", F.posexplode(F.slice("trail", F.lit(2), F.size("trail"))).alias("depth", "_anc")).join(among, F.col("_anc") == F.col("_a")).select("path", "depth", "_anc", "ordinal"))
    numbers = spread.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ordinal"))), lambda x: x["ordinal"].cast("string")), ".").alias("number"))
    below = spread.groupBy(F.col("_anc").alias("path")).agg(F.count(F.lit(1)).alias("size"))
    tour = before(keys.select("path", "key"), [F.col("key")], {"first": 1})
    whole = of(tour.join(numbers, "path").join(below, "path"), "path", "volume").join(volumes.select(F.col("path").alias("_vp"), F.col("directory").alias("_vd"), F.col("volume").alias("_vn")), F.col("volume") == F.col("_vn"))
    whole = settle(whole.withColumn("_label", F.when(F.col("path") == F.col("_vp"), F.concat(F.lit("vol"), F.col("volume").cast("string"))).otherwise(F.concat(F.lit("d"), F.col("volume").cast("string"), F.lit("-"), path_slug(F.expr("substring(path, length(_vd) + 2)"))))))
    owner = whole.groupBy(F.col("_label").alias("_l")).agg(F.min("first").alias("_f"))
    labelled = whole.join(owner, F.col("_label") == F.col("_l"))
    documents = labelled.select("path", "volume", (F.size("key") - 1).alias("rank"), "number", "first", (F.col("first") + F.col("size") - 1).alias("last"), F.when(F.col("first") == F.col("_f"), F.col("_label")).otherwise("").alias("label"))
    findings.append(labelled.where("first <> _f").select(F.lit("label again").alias("check"), F.col("path").alias("subject"), F.col("_label").alias("detail")))
    out = findings[0]
    for more in findings[1:]:
        out = out.unionByName(more)
    return Walk(volumes, documents, out)


def selected(found: Walk, wanted: DataFrame) -> Walk:
    """The walk of some volumes (wanted: volume) alone, numbered anew in their order; labels follow the new numbers."""
    kept = found.volumes.join(wanted.select("volume").distinct(), "volume", "left_semi")
    order = ordinals(kept.withColumn("_all", F.lit(0)), "_all", "volume").select(F.col("volume").alias("_old"), F.col("ordinal").cast("int").alias("_new"))
    anew = lambda c: F.regexp_replace(c, r"^(vol|d)\d+", F.concat(F.lit("$1"), F.col("_new").cast("string")))
    volumes = kept.join(order, F.col("volume") == F.col("_old")).select(F.col("_new").alias("volume"), "path", "directory", anew(F.col("label")).alias("label"))
    documents = found.documents.join(order, F.col("volume") == F.col("_old"))
    number = F.regexp_replace("number", r"^\d+", F.col("_new").cast("string"))
    gap = documents.groupBy("_new").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("_from"))
    shift = before(gap, [F.col("_new")], {"_to": F.col("n")}).select(F.col("_new").alias("_nn"), "_from", "_to")
    moved = documents.join(shift, F.col("_new") == F.col("_nn")).withColumn("first", F.col("first") - F.col("_from") + F.col("_to")).withColumn("last", F.col("last") - F.col("_from") + F.col("_to"))
    return Walk(volumes, moved.select("path", F.col("_new").alias("volume"), "rank", number.alias("number"), "first", "last", anew(F.col("label")).alias("label")), found.findings)


def first_entries(entries: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, path, line of each bibliography key's first entry in the walk's order, and the others, for entries (path, line, key): a document that isn't walked comes last, by path."""
    placed = entries.join(documents.select(F.col("path").alias("_p"), F.col("first").alias("_o")), F.col("path") == F.col("_p"), "left").select("key", "path", "line", F.col("_o").isNull().alias("_far"), F.coalesce("_o", F.lit(0)).alias("_o"))
    place = F.struct("_far", "_o", "path", "line")
    first = placed.groupBy("key").agg(F.min(place).alias("f")).select("key", "f.path", "f.line")
    return first, entries.select("key", "path", "line").join(first, ["key", "path", "line"], "left_anti")
