"""Mixing sources to target weights by capped water-filling, and seeded sampling of whole and fractional repetitions.

Every source gets a share of the wanted total by its weight, clamped at `max_epochs` times its own size; what the clamp
frees goes to the other sources by weight until none is above. The level is found in closed form: with the sources in
order of cap / weight, a source is clamped exactly if its ratio is at most the level that would hold with all before it
clamped. A source whose target is r times its size takes every document floor(r) times, and once more the documents that
come first in a seeded order (md5 of seed and id) until the rest of the target is filled; the document across that point
is in if at least half of it fits. So a source misses its target by half a document at most.

The seeded order has 4096 buckets by the key's first digits. Sizes are summed by source and bucket (combined before the
shuffle, so a source with a third of all rows costs no more than any other), and only the documents of the one bucket in
which a source's point lies are ordered by a window.

Defined results: a null text has size 0; null is a source of its own, after all others; an empty table gives an empty
result; rows that repeat an id and a text are decided one by one; other columns are passed on (`mix`) or ignored (`plan_mix`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.operators.prefix import before

from .common import WORD, settle, text_of

#: The plan has one row for each source; it is broadcast up to this many bytes of names and rows, and joined by a shuffle beyond.
BROADCAST_BYTES = 8 << 20


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def order_key(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """md5 of seed, id and the text's md5: rows that share an id are spread like any others, and no text is copied."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.md5(text_of(text))))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and the seeded key and bucket of every document."""
    return docs.select("doc_id", "source", words().alias("size"), order_key(seed).alias("_key")).withColumn("_bucket", F.substring("_key", 1, 3))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, target: the water-filling over a table (source, source_size) with one row for each source.

    Sources may be many: ranks and running sums come from range partitions, only sums over all of them from the driver.
    """
    sizes = settle(sizes)
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    named = before(sizes, [F.col("source").asc_nulls_last()], {"_rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    capped = settle(named.withColumn("_weight", weight).withColumn("_cap", F.col("source_size").cast("double") * max_epochs).withColumn("_ratio", F.col("_cap") / F.col("_weight")))
    all_weights = capped.agg(F.sum("_weight")).first()[0] or 0.0
    placed = before(capped, [F.col("_ratio"), F.col("source").asc_nulls_last()], {"_caps": F.col("_cap"), "_lesser": F.col("_weight")})
    level = (F.lit(total) - F.col("_caps")) / (F.lit(all_weights) - F.col("_lesser"))
    filled = settle(placed.withColumn("_level", level).withColumn("_clamped", F.col("_ratio") <= F.col("_level")))
    water = filled.where(~F.col("_clamped")).agg(F.max("_level")).first()[0]
    return filled.select("source", "source_size", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.lit(water).cast("double") * F.col("_weight")).alias("target"))


def plan_mix(keyed: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row for each source: source_size, target, whole repetitions, and the last unit (key, id) that gets one more, with how many of its rows do.

    `keyed` has the columns of `sized`; it is read twice, so it should be settled.
    """
    buckets = settle(keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")))
    plan = targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = settle(plan.withColumn("whole", F.floor(epochs)).withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("_bucket")
    at = (
        buckets.withColumn("_upto", F.sum("_words").over(upto))
        .withColumn("_before", F.col("_upto") - F.col("_words"))
        .withColumnRenamed("source", "_source")
        .join(plan.select("source", "_rest"), F.col("_source").eqNullSafe(F.col("source")))
        .where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_upto")))
        .select("_source", F.col("_bucket").alias("_cut"), "_before", "_rest")
    )
    inside = keyed.join(_small(settle(at)), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_cut")))
    units = inside.groupBy("source", "_key", "doc_id", "size", "_before", "_rest").agg(F.count(F.lit(1)).alias("_rows"))
    step = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("_start", F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_rows")).over(step), F.lit(0)))
    # A row is in if at least half of it fits, so of a unit's rows the first of them are.
    fits = F.when(F.col("size") > 0, F.floor((F.col("_rest") - F.col("_start")) / F.col("size") + 0.5)).when(F.col("_start") <= F.col("_rest"), F.col("_rows")).otherwise(F.lit(0))
    cuts = (
        units.withColumn("_fit", F.least(fits, F.col("_rows")))
        .where(F.col("_fit") > 0)
        .groupBy("source")
        .agg(F.max(F.struct("_key", "doc_id", "_fit", "_rows")).alias("_last"))
        .withColumnRenamed("source", "_source")
    )
    at = at.select(F.col("_source").alias("_at"), "_cut")
    return settle(
        plan.join(at, F.col("source").eqNullSafe(F.col("_at")), "left")
        .join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("source", "source_size", "target", "whole", (F.col("_rest") >= F.col("source_size")).alias("_all"), (F.col("_rest") > 0).alias("_some"), "_cut", "_last", "_rest")
    )


def _small(plan: DataFrame) -> DataFrame:
    """The plan marked for broadcast if its measured size is below the bound, else as it is: joins then shuffle, and AQE splits a hot source."""
    name = plan.columns[0]
    n, chars = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    return F.broadcast(plan) if 200 * n + chars <= BROADCAST_BYTES else plan


def repeats(plan: DataFrame, keyed: DataFrame) -> DataFrame:
    """`keyed` (doc_id, source, _key, _bucket and any others) with source_size, target and repeats (how often the mix takes the row)."""
    split = plan.where("_last._fit < _last._rows").limit(1).count() > 0
    plan = plan.withColumnRenamed("source", "_of")
    own, last = F.struct("_key", "doc_id"), F.struct("_last._key", "_last.doc_id")
    # Without a cut the rest is 0 or, by rounding, all of the source.
    before_cut = F.when(F.col("_cut").isNull(), F.col("_all")).otherwise(
        (F.col("_bucket") < F.col("_cut")) | ((F.col("_bucket") == F.col("_cut")) & F.col("_last").isNotNull() & F.coalesce(own <= last, F.lit(False)))
    )
    joined = keyed.join(_small(plan.select("_of", "source_size", "target", "whole", "_all", "_some", "_cut", "_last")), F.col("source").eqNullSafe(F.col("_of")), "left")
    parted = F.col("_last").isNotNull() & F.coalesce((F.col("_last._fit") < F.col("_last._rows")) & (own == last), F.lit(False)) & F.col("_some")
    once_more = F.when(F.col("_some") & before_cut, 1).otherwise(0)
    out = (joined.where(~parted) if split else joined).withColumn("repeats", F.col("whole") + once_more).select(*keyed.columns, "source_size", "target", "repeats")
    if split:
        # One unit of a source at most: its rows are counted by all they hold, and the first of them get one more.
        names = [*keyed.columns, "source_size", "target", "whole"]
        same = joined.where(parted).withColumn("_hash", F.xxhash64(F.to_json(F.struct(*keyed.columns)))).groupBy("source", "_hash")
        same = same.agg(*[F.first(c).alias(c) for c in names if c != "source"], F.first("_last._fit").alias("_fit"), F.count(F.lit(1)).alias("_n"))
        earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each = same.withColumn("_more", F.col("_fit") - earlier).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
        out = out.unionByName(each.withColumn("repeats", F.col("whole") + F.when(F.col("_i") <= F.col("_more"), 1).otherwise(0)).select(*out.columns))
    return out


def mix_plan_for(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 9) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken for every document."""
    keyed = settle(sized(docs, seed))
    return repeats(plan_mix(keyed, weights, share, max_epochs), keyed).withColumn("taken", F.col("repeats") * F.col("size")).drop("_key", "_bucket")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 9) -> DataFrame:
    """The mixed table: the rows of `docs`, each as often as the mix takes it. Texts are not shuffled."""
    plan = plan_mix(settle(sized(docs, seed)), weights, share, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), "doc_id", "source", order_key(seed).alias("_key")).withColumn("_bucket", F.substring("_key", 1, 3))
    return repeats(plan, keyed).select("_row", F.explode(F.sequence(F.lit(1), F.greatest(F.col("repeats"), F.lit(1)).cast("int"))).alias("_nth"), "repeats").where("repeats > 0").select("_row.*")
