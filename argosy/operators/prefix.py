"""Running sums over a whole table without a window that spans it: sums within range partitions, after those of the partitions before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.plans.star import stored


#: `monotonically_increasing_id` holds the partition above these bits and the row's place in it below.
ROW_BITS = 33
ROW = (1 << ROW_BITS) - 1


def dealt_in_order(df: DataFrame, order: Sequence[Column], *columns: str) -> DataFrame:
    """The columns of `df` (all by default) and _row, stored: rows of a later range partition have a higher _row >> ROW_BITS, and within it _row & ROW counts from 0 in `order`."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ordered.select(*(columns or ordered.columns), F.monotonically_increasing_id().alias("_row")))


def before(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column | int]) -> DataFrame:
    """`df` with, under each name, the sum of an expression over all rows before the row in `order` (0 for the first); the order should be total. The number 1 counts rows.

    Rows are dealt to range partitions once, and counted as they are sorted there; other sums take a window over each partition. Only one
    row of totals for each partition is put in order in one task and sent to all.
    """
    dealt = dealt_in_order(df, order)
    part, own_row = F.shiftright("_row", ROW_BITS), F.col("_row").bitwiseAND(ROW)
    sums = {n: F.lit(x) if isinstance(x, int) and x != 1 else x for n, x in sums.items()}
    totals = dealt.groupBy(part.alias("_part")).agg(*[(F.count(F.lit(1)) if isinstance(x, int) else F.sum(x)).alias(f"_sum_{n}") for n, x in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums])
    own = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("_part", part).select("*", *[(own_row if isinstance(x, int) else F.coalesce(F.sum(x).over(own), F.lit(0))).alias(f"_in_{n}") for n, x in sums.items()])
    joined = inner.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))  # a row for each partition
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])
