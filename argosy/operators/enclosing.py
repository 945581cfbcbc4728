"""The innermost span that holds each place, and the place's order there, for nested spans of any depth and documents of any size.

A sweep with a stack, told in running sums. Opens, closes and places are put in order; the number of opens less the closes before an event is
the height of the stack. The span on top at a place of height d is the last one opened at height d, so in the order of (document, height,
position) the number of opens before a place names it: an equal number is the span's own. Sums come from range partitions that cut documents
anywhere (`prefix.before`), and the join is on a number that one span has, so neither a long document nor a full block meets in a task.

Defined results: spans are half open; one that holds nothing (stop at or before start) holds no place; of spans that open together the longer
one is outside, of equal ones the one of the greater id is inside; places outside all spans have no host and are ordered within their document;
null positions have neither; spans that cross are refused; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.operators.prefix import before
from argosy.plans.star import settle

CLOSE, OPEN, PLACE = 0, 1, 2


def _events(points: DataFrame, spans: DataFrame) -> DataFrame:
    """path, pos, kind, tie, id, start, stop, p: opens, closes and places; p is a place's own row."""
    real = spans.select("path", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("id").cast("string").alias("id")).where("start < stop").distinct()
    none = F.lit(None).cast(points.schema.simpleString())
    opens = real.select("path", F.col("start").alias("pos"), F.lit(OPEN).alias("kind"), (-F.col("stop")).alias("tie"), F.lit("").alias("tail"), "id", "start", "stop", none.alias("p"))
    # Equal spans close in the opposite order: the complement of the id's code points would do, but a stack only counts.
    closes = real.select("path", F.col("stop").alias("pos"), F.lit(CLOSE).alias("kind"), (-F.col("start")).alias("tie"), F.lit("").alias("tail"), "id", "start", "stop", none.alias("p"))
    whole = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    places = points.select("path", F.col("line").cast("long").alias("pos"), F.lit(PLACE).alias("kind"), F.lit(0).cast("long").alias("tie"), F.to_json(whole).alias("tail"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), whole.alias("p"))
    return opens.unionByName(closes).unionByName(places)


def _stacked(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The events with depth: of the span that opens or closes, or of the one on top at a place."""
    order = [F.col(c) for c in ("path", "pos", "kind", "tie", "id", "tail")]
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    placed = before(_events(points, spans).where("pos is not null"), order, {"depth": step})
    return placed.withColumn("depth", F.col("depth") + F.when(F.col("kind") == OPEN, 1).otherwise(0))


def crossing(spans: DataFrame) -> DataFrame:
    """path, id, start, stop of spans that end outside the one in which they began, or hold such a span's end."""
    held = _stacked(spans.select("path", F.lit(None).cast("long").alias("line")).limit(0), spans)
    ends = held.groupBy("path", "id", "start", "stop").agg(F.max(F.when(F.col("kind") == OPEN, F.col("depth"))).alias("o"), F.max(F.when(F.col("kind") == CLOSE, F.col("depth"))).alias("c"))
    # Equal spans share their opens and closes, in whichever order.
    alike = ends.groupBy("path", "start", "stop").agg(F.sort_array(F.collect_list("o")).alias("os"), F.sort_array(F.collect_list("c")).alias("cs"), F.collect_list("id").alias("ids"))
    return alike.where(~F.col("os").eqNullSafe(F.col("cs"))).select("path", F.explode("ids").alias("id"), "start", "stop")


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points' columns, host (the innermost span's id, null outside), depth and at (order, from 1, among the host's own places), for points (path, line, ...) and spans (path, start, stop, id)."""
    points, spans = settle(points), settle(spans)  # each is read more than once
    if crossing(spans).limit(1).count():
        raise ValueError("spans cross")
    stacked = _stacked(points, spans).where(F.col("kind") != CLOSE)
    order = [F.col(c) for c in ("path", "depth", "pos", "kind", "tie", "id", "tail")]
    named = settle(before(stacked, order, {"_opens": F.when(F.col("kind") == OPEN, 1).otherwise(0), "_rank": F.lit(1)}))
    hosts = named.where(F.col("kind") == OPEN).select((F.col("_opens") + 1).alias("_n"), F.col("id").alias("host"))
    places = named.where(F.col("kind") == PLACE).select("path", "p", "depth", "_rank", F.when(F.col("depth") > 0, F.col("_opens")).alias("_host"))
    # A host's places stand one after the other in this order, but for the opens of its own depth, which come after its last.
    first = places.groupBy(F.col("path").alias("_path"), F.col("_host").alias("_h")).agg(F.min("_rank").alias("_first"))
    ranked = places.join(first, F.col("path").eqNullSafe(F.col("_path")) & F.col("_host").eqNullSafe(F.col("_h"))).join(hosts, F.col("_host") == F.col("_n"), "left")
    return ranked.select("p.*", "host", F.col("depth").cast("int"), (F.col("_rank") - F.col("_first") + 1).cast("long").alias("at"))
