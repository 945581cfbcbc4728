"""Read queries over a snapshot: find, show, edges, stats, trace, scoring set. All return DataFrames.

Lists with a bound carry their order as `rank` (from 1), numbered over the bounded rows alone; lists without one are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions.graph import BANDS, RELATIONS, SCORING, WALKED, band, bearing_text, contribution, display, fold, relation_rank, scoring
from argosy.plans.star import settle


class Refused(ValueError):
    """A selection outside the vocabulary; `items` lists every reason."""

    def __init__(self, items: list[str]):
        super().__init__("; ".join(items))
        self.items = items


SORTS = ("id", "strength", "dependents")


def check_find(kinds, sort, order, limit, pending, low, high) -> None:
    from argosy.functions.graph import KINDS

    items = [f"{k!r} is no kind" for k in kinds or () if k not in KINDS]
    items += [f"{sort!r} is no sort"] if sort is not None and sort not in SORTS else []
    items += [f"{order!r} is no order"] if order not in ("asc", "desc") else []
    items += ["pending stands beside a bound"] if pending and (low is not None or high is not None) else []
    items += ["limit needs a sort"] if limit is not None and sort is None else []
    items += ["limit is 0"] if limit == 0 else []
    if items:
        raise Refused(items)


def keys(sort: str, order: str) -> list[tuple[str, bool]]:
    """Column and whether it ascends; pending is below every number, and ties ascend in either order."""
    up = order == "asc"
    return {"id": [("id", up)], "strength": [("strength", up), ("id", True)], "dependents": [("dependents", up), ("strength", True), ("id", True)]}[sort]


def _ordered(by: Sequence[tuple[str, bool]], flip: bool = False) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up != flip else F.col(c).desc_nulls_last() for c, up in by]


def limited(df: DataFrame, by: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows, or the last |n| in the same order, with their rank."""
    cut = df.orderBy(*_ordered(by, flip=n < 0)).limit(abs(n))
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*_ordered(by))))


def under(host: Column, path: str) -> Column:
    """At the path or below it; the root holds every hosted node."""
    path = path.strip("/")
    return host.isNotNull() if path in ("", ".") else (host == path) | host.startswith(path + "/")


def find(nodes: DataFrame, kinds: Sequence[str] = (), title: str | None = None, label: str | None = None, path: str | None = None, low: float | None = None, high: float | None = None,
         pending: bool = False, min_dependents: int | None = None, sort: str | None = None, order: str = "asc", limit: int | None = None) -> DataFrame:
    """Nodes that pass every filter given."""
    check_find(kinds, sort, order, limit, pending, low, high)
    held = F.lit(True)
    if kinds:
        held &= F.col("kind").isin(*kinds)
    for column, wanted in (("title", title), ("label", label)):
        if wanted:
            held &= F.contains(fold(F.col(column)), fold(F.lit(wanted)))
    if path is not None:
        held &= under(F.col("host"), path)
    if low is not None:
        held &= F.col("strength") >= low
    if high is not None:
        held &= F.col("strength") < high
    if pending:
        held &= F.col("strength").isNull()
    if min_dependents is not None:
        held &= F.col("dependents") >= min_dependents
    found = nodes.where(held).select("id", "kind", "title", "label", "host", "strength", "dependents")
    by = keys(sort or "id", order)
    return found.orderBy(*_ordered(by)) if limit is None else limited(found, by, limit)


def last_row(rows: DataFrame, id: str, order: str | None = None) -> DataFrame:
    """The row of an id; of several the last by the column `order`, which numbers rows as they stand in their file (without one, by content)."""
    own, names = rows.where(F.col("id") == id), [c for c in rows.columns if c != "id"]
    best = F.max_by(F.struct(*names), F.col(order)) if order else F.max(F.struct(*names))
    return own.groupBy("id").agg(best.alias("r")).select("id", "r.*")


def show(nodes: DataFrame, edges: DataFrame, id: str, order: str | None = None) -> DataFrame:
    """One node's record with its band and its edge counts."""
    counts = edges.where((F.col("source") == id) | (F.col("target") == id)).agg(F.count_if(F.col("target") == id).alias("edges_in"), F.count_if(F.col("source") == id).alias("edges_out"))
    fields = ("id", "kind", "title", "label", "status", "rigor", "manually_scored", "host", "strength", "dependents")
    last = last_row(nodes.select(*fields, *([order] if order else [])), id, order)
    return last.join(F.broadcast(counts), how="inner", on=F.lit(True)).select(*fields, band(F.col("strength")).alias("band"), "edges_in", "edges_out")  # one row of counts


#: What each kind's record shows after kind, id, title, host and summary page, in order.
SHOWN = {
    "claim": ("rigor", "manually-scored", "strength", "strength-band", "rationale", "premises"), "analysis": ("rigor", "manually-scored", "strength", "strength-band", "rationale"),
    "experiment": ("status", "rigor", "manually-scored"), "axiom": ("label", "rigor"), "work": ("label", "rigor", "rationale"),
}


def show_record(nodes: DataFrame, edges: DataFrame, id: str, order: str | None = None) -> DataFrame:
    """at, key, value of one node's record by its kind, then a row for each of its edges in and out, in the fixed order of edges."""
    held = nodes if "rationale" in nodes.columns else nodes.withColumn("rationale", F.lit(None).cast("string"))
    premises = edges.where((F.col("target") == id) & F.col("relation").isin("supports", "founds")).agg(F.count(F.lit(1)).alias("_premises"))
    one = last_row(held, id, order).join(F.broadcast(premises), F.lit(True))  # one row
    text = {
        "kind": F.col("kind"), "id": F.col("id"), "title": F.col("title"), "host": F.col("host"), "summary": F.when(F.col("host").isNotNull(), F.concat(F.substring_index("host", "/", 1), F.lit("/summary.md"))),
        "rigor": F.coalesce(F.col("rigor").cast("string"), F.lit("pending")), "manually-scored": F.coalesce("manually_scored", F.lit(False)).cast("string"), "strength": display(F.col("strength")), "strength-band": band(F.col("strength")),
        "rationale": F.coalesce("rationale", F.lit("")), "premises": F.col("_premises").cast("string"), "status": F.col("status"), "label": F.col("label"),
    }
    fields = None
    for kind, names in SHOWN.items():
        rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("key"), text[n].alias("value")) for i, n in enumerate(("kind", "id", "title", "host", "summary", *names))])
        fields = F.when(F.col("kind") == kind, rows) if fields is None else fields.when(F.col("kind") == kind, rows)
    record = one.select(F.explode(fields).alias("x")).select("x.*")
    bullet = F.concat_ws(" ", "relation", "source", "target", F.when(F.col("bearing_pending"), "pending").otherwise(F.col("bearing").cast("string")), F.when(F.col("manually_scored"), "(manual)"))
    ends = [(F.col("target") == id, "edge-in", 100), (F.col("source") == id, "edge-out", 200)]
    listed = [edges.where(at).select((F.lit(n) + relation_rank(F.col("relation"))).alias("at"), F.lit(key).alias("key"), bullet.alias("value")) for at, key, n in ends]
    return record.unionByName(listed[0]).unionByName(listed[1]).orderBy("at", "value")


def edges_of(edges: DataFrame, relations: Sequence[str] = (), id: str | None = None, direction: str = "both") -> DataFrame:
    """Edges of the relations, of one node if given, in the fixed order: relation, source, target, replaced relation."""
    if bad := [f"{r!r} is no relation" for r in relations if r not in RELATIONS] + ([f"{direction!r} is no direction"] if direction not in ("in", "out", "both") else []):
        raise Refused(bad)
    held = F.col("relation").isin(*relations) if relations else F.lit(True)
    if id is not None:
        at = {"in": F.col("target") == id, "out": F.col("source") == id}
        held &= at.get(direction, at["in"] | at["out"])
    found = edges.where(held).select("relation", "replaced_relation", "source", "target", "context", "bearing", "bearing_pending")
    return found.orderBy(relation_rank(F.col("relation")), "source", "target", relation_rank(F.col("replaced_relation")).asc_nulls_first())


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def band_counts(nodes: DataFrame) -> DataFrame:
    """Claims of every band in ladder order, unknown last, zeros included."""
    found = nodes.where(F.col("kind") == "claim").groupBy(band(F.col("strength")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    ladder = nodes.sparkSession.createDataFrame([(i + 1, b) for i, b in enumerate([*(b for b, _ in BANDS), "unknown"])], "rank int, band string")
    return ladder.join(found, "band", "left").select("rank", "band", F.coalesce("n", F.lit(0)).alias("n"))


def relation_census(edges: DataFrame) -> DataFrame:
    """Every relation's count, whether the bearing walk asks it, and for scoring relations the count of each bearing (numbers ascending, pending last)."""
    scored = F.when(scoring(F.col("relation")), bearing_text(F.col("bearing"), F.col("bearing_pending")))
    each = edges.groupBy("relation", "bearing", "bearing_pending", scored.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    all_names = edges.sparkSession.createDataFrame([(i + 1, r, r in WALKED, r in SCORING) for i, r in enumerate(RELATIONS)], "rank int, relation string, walked boolean, scoring boolean")
    total = each.groupBy("relation").agg(F.sum("n").alias("n"), F.count("text").alias("distinct_bearings"), F.sum(F.when(F.col("bearing_pending"), F.col("n")).otherwise(0)).alias("pending"), F.min("bearing").alias("least"), F.max("bearing").alias("most"))
    bare = lambda c: F.when(F.col("scoring"), F.coalesce(F.col(c), F.lit(0)))
    return all_names.join(total, "relation", "left").select(
        "rank", "relation", "walked", F.coalesce("n", F.lit(0)).alias("n"), bare("distinct_bearings").alias("distinct_bearings"), bare("pending").alias("pending"), F.when(F.col("scoring"), F.col("least")).alias("least"), F.when(F.col("scoring"), F.col("most")).alias("most")
    )


def bearing_counts(edges: DataFrame) -> DataFrame:
    """relation, bearing (text), n of the scoring relations."""
    return edges.where(scoring(F.col("relation"))).groupBy("relation", "bearing", "bearing_pending").agg(F.count(F.lit(1)).alias("n"))


def provenance_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many values people and models set, of nodes and of scoring edges."""
    what = lambda df, name: df.agg(F.count_if(F.col("manually_scored")).alias("manual"), F.count_if(~F.col("manually_scored")).alias("model")).select(F.lit(name).alias("item"), "manual", "model")
    return what(nodes.where(F.col("kind").isin("claim", "analysis", "experiment")), "rigor").unionByName(what(edges.where(F.col("relation").isin(*WALKED)), "bearing"))


def volume_counts(nodes: DataFrame) -> DataFrame:
    """Claims and experiments hosted in each volume (top folder)."""
    return nodes.where("host is not null").groupBy(F.substring_index("host", "/", 1).alias("volume")).agg(F.count_if(F.col("kind") == "claim").alias("claims"), F.count_if(F.col("kind") == "experiment").alias("experiments"))


def highest_leverage(nodes: DataFrame, below: float = 0.65, n: int = 10) -> DataFrame:
    """Weak claims with dependents, most dependents first."""
    weak = nodes.where((F.col("kind") == "claim") & (F.col("strength") < below) & (F.col("dependents") >= 1)).select("id", "title", "strength", "dependents")
    return limited(weak, keys("dependents", "desc"), n)


def weakest(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The n claims of least strength, pending ones aside."""
    return limited(nodes.where((F.col("kind") == "claim") & F.col("strength").isNotNull()).select("id", "title", "strength"), keys("strength", "asc"), n)


def scoring_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a scoring run walks: every rigor item, then every bearing item. `part` and the sort keys give the order."""
    rigor = nodes.where(~F.col("kind").isin("work", "axiom")).select(F.lit(1).alias("part"), F.lit(None).cast("string").alias("relation"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), "manually_scored")
    return rigor.unionByName(edges.where(F.col("relation").isin(*WALKED)).select(F.lit(2).alias("part"), "relation", "source", "target", "manually_scored"))


def contributions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every scoring edge with its source's strength, its contribution, and whether a planned experiment excludes it."""
    sources = nodes.select(F.col("id").alias("_id"), F.col("strength").alias("source_strength"), ((F.col("kind") == "experiment") & (F.col("status") != "run")).alias("_planned"))
    joined = edges.where(scoring(F.col("relation"))).join(sources, F.col("source") == F.col("_id"), "left")
    out = F.coalesce("_planned", F.lit(False))
    return joined.select("relation", "source", "target", "bearing", "source_strength", out.alias("excluded"), F.when(~out, contribution(F.col("relation"), F.col("bearing"), F.col("source_strength"))).alias("contribution"))


def trace(nodes: DataFrame, edges: DataFrame, id: str, direction: str, sort: str = "depth", order: str = "asc", limit: int | None = None) -> DataFrame:
    """The whole closure from a node against ("in") or along ("out") the scoring edges; every edge once, at the depth it is first reached."""
    if direction not in ("in", "out"):
        raise Refused([f"{direction!r} is no direction"])
    near, far = ("target", "source") if direction == "in" else ("source", "target")
    walk = edges.where(scoring(F.col("relation"))).select("relation", "source", "target")
    front = settle(nodes.where(F.col("id") == id).select("id").distinct())
    seen, found, depth = front, None, 0
    while True:
        depth += 1
        step = settle(walk.join(front.select(F.col("id").alias(near)), near, "left_semi").withColumn("depth", F.lit(depth)))
        if not step.limit(1).count():
            break
        found = step if found is None else found.unionByName(step)
        front = settle(step.select(F.col(far).alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = settle(seen.unionByName(front))
    if found is None:
        found = walk.limit(0).withColumn("depth", F.lit(0))
    valued = found.join(contributions(nodes, edges), ["relation", "source", "target"]).select("relation", "source", "target", "depth", F.col("source_strength").alias("strength"), "contribution", "excluded")
    rank = valued.withColumn("_r", relation_rank(F.col("relation")))
    fixed = [("_r", True), ("source", True), ("target", True)]
    by = [("depth", order == "asc"), *fixed] if sort == "depth" else [("excluded", True), ("contribution", order == "asc"), ("depth", True), *fixed]
    return (rank.orderBy(*_ordered(by)) if limit is None else limited(rank, by, limit)).drop("_r")


def citations_of(docs: DataFrame, id: str) -> DataFrame:
    """path, line (from 1), text of every link whose title is the id, outside code."""
    from argosy.functions.text import links_of

    return links_of(docs).where(F.col("link.title") == id).select("path", "line", F.col("link.text").alias("text")).orderBy("path", "line", "text")
