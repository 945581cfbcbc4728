"""Minting ids for a whole table of seeds: open addressing in rounds.

An id's body is read off a hash of its seed, so two seeds may want one id. The rule is that of a single pass in ascending order of the seed: each takes
its first derivation that is neither reserved nor taken by an earlier one. Rounds give the same result without the pass: every seed without an id
asks for its next derivation, an id goes to the least seed that ever asked for it, and whoever loses it asks on (all ids prefer
seeds alike, so proposals settle in the serial order). The first round is one aggregate over all seeds; those after it move only losers, joined
with the ids held, and what they change is a small overlay. Spark sends the losers to all tasks where their measured size allows it.

Defined results: null seeds get no id; seeds that repeat are one; reserved ids that are null count for nothing; an empty table gives an
empty result; a table of more seeds than half the ids of that length is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosy.plans.star import settle

# The alphabet of id bodies and their length.
ALPHABET, DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789", 6
_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def derived(prefix: str, seed: Column, n: Column | int = 0, digits: int = DIGITS) -> Column:
    """The nth derivation of a seed's id: the first eight bytes of the SHA-256 of the seed (from the first re-derivation on, of the seed, a NUL and n) as digits of the alphabet, the last digit first."""
    n = F.lit(n) if isinstance(n, int) else n
    again = F.when(n > 0, F.concat(F.lit("\x00"), n.cast("string"))).otherwise("")
    number = F.conv(F.substring(F.sha2(F.encode(F.concat(seed, again), "UTF-8"), 256), 1, 16), 16, 36)
    return F.concat(F.lit(f"{prefix}-"), F.translate(F.reverse(F.right(F.lpad(number, 13, "0"), F.lit(digits))), _BASE36, ALPHABET))


def digits_for(n: int, spare: int = 16) -> int:
    """The least length, of six at least, whose ids are `spare` times as many as n."""
    digits = DIGITS
    while 36**digits < spare * n:
        digits += 1
    return digits


def mint(seeds: DataFrame, prefix: str, reserved: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """seed, id for every distinct seed of `seeds` (seed), none of them in `reserved` (id)."""
    spark = seeds.sparkSession
    own = seeds.select(F.col("seed").cast("string").alias("seed")).where("seed is not null").distinct()
    shut = spark.createDataFrame([], "id string") if reserved is None else reserved.select("id").where("id is not null").distinct()
    shut = settle(shut)
    asked = settle(own.withColumn("n", F.lit(0)).withColumn("id", derived(prefix, F.col("seed"), 0, digits)))
    if 2 * (asked.count() + shut.count()) > 36**digits:
        raise ValueError(f"too many seeds for ids of {digits} characters")
    least = lambda df: df.groupBy("id").agg(F.min(F.struct("seed", "n")).alias("w")).select("id", "w.seed", "w.n")
    won = settle(least(asked).join(shut, "id", "left_anti"))
    lost = settle(asked.join(won.select("seed"), "seed", "left_anti").select("seed", "n"))
    changed: DataFrame | None = None  # ids that another seed holds than `won` says
    while lost.count():
        asked = settle(lost.select("seed", (F.col("n") + 1).alias("n")).withColumn("id", derived(prefix, F.col("seed"), F.col("n"), digits)))
        named = asked.select("id").distinct()
        before = won.join(named, "id", "left_semi")
        if changed is not None:
            before = before.join(changed, "id", "left_anti").unionByName(changed.join(named, "id", "left_semi"))
        now = settle(least(asked.unionByName(before)).join(shut, "id", "left_anti"))
        rest = asked.select("seed", "n").unionByName(before.select("seed", "n"))
        lost = settle(rest.join(now.select("seed"), "seed", "left_anti"))
        changed = settle(now if changed is None else changed.join(now, "id", "left_anti").unionByName(now))
    held = won if changed is None else won.join(changed, "id", "left_anti").unionByName(changed)
    return held.select("seed", "id")


def minted(df: DataFrame, prefix: str, seed: Column, reserved: DataFrame | None = None) -> DataFrame:
    """`df` with a column id, minted for its seeds; rows of one seed share it."""
    found = mint(df.select(seed.cast("string").alias("seed")), prefix, reserved)
    return df.join(found.withColumnRenamed("seed", "_seed"), seed.cast("string") == F.col("_seed"), "left").drop("_seed")


def derived_sql(prefix: str, seed: str, n: str = "0", digits: str = str(DIGITS)) -> str:
    """`derived` in DuckDB."""
    number = f"('0x' || left(sha256(({seed})::varchar || case when {n} > 0 then chr(0) || {n}::varchar else '' end), 16))::uhugeint"
    return f"('{prefix}-' || array_to_string(list_transform(range({digits}), lambda i: substr('{ALPHABET}', ({number} // (36::uhugeint ** i)::uhugeint % 36)::int + 1, 1)), ''))"
