"""Asks to a judge: templates, digests, inputs shared by a group, runs over a judge, what lands in the records, replays."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosy.functions.graph import judged_hash
from argosy.operators import score
from argosy.operators.query import Refused
from argosy.plans.star import settle

SLOT = re.compile(r"\{\{\s*([a-z][a-z0-9-]*)\s*\}\}")


def slots(template: str) -> list[str]:
    """The names of a template's slots, each once, in order."""
    return list(dict.fromkeys(SLOT.findall(template)))


def rendered(template: str, values: dict[str, str]) -> str:
    """The template with its slots filled; a slot without a value and a value without a slot are refused."""
    names = slots(template)
    items = [f"no value for {n}" for n in names if n not in values] + [f"no slot {v}" for v in values if v not in names]
    if items:
        raise Refused(items)
    return SLOT.sub(lambda m: values[m[1]], template)


def render_column(template: str, values: dict[str, Column]) -> Column:
    """`rendered` over columns, in the JVM."""
    rendered(template, {k: "" for k in values})
    pieces = SLOT.split(template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(pieces)])


def digest(*parts: Column) -> Column:
    """SHA-256 of parts, each behind its length in bytes."""
    return judged_hash(*parts)


def ask_digest(kind: Column, instructions: Column, true_letter: Column, criteria: Column, state: Column) -> Column:
    """The digest of a question (its criteria in key order; its own key is no part of it) and a state."""
    bit = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    pairs = F.array_sort(F.map_entries(criteria))
    listed = F.array_join(F.transform(pairs, lambda p: F.concat(bit(p["key"]), bit(p["value"]))), "")
    return F.sha2(F.concat(bit(kind), bit(instructions), bit(true_letter), listed, bit(state)), 256)


def shared_inputs(items: DataFrame, group: str, item: str, inputs: str) -> DataFrame:
    """group, item, key, value, shared: an item's inputs, one row each; an entry is shared if every item of the group has it with that value."""
    sizes = items.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    rows = items.select(group, item, F.explode(inputs).alias("key", "value"))
    held = rows.groupBy(F.col(group).alias("_h"), F.col("key").alias("_k"), F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    everywhere = held.join(sizes, F.col("_h") == F.col("_g")).where("_c = _n").select("_h", "_k", "_v")
    joined = rows.join(everywhere, (F.col(group) == F.col("_h")) & (F.col("key") == F.col("_k")) & F.col("value").eqNullSafe(F.col("_v")), "left")
    return joined.select(group, item, "key", "value", F.col("_h").isNotNull().alias("shared"))


def timestamp(moment: dt.datetime) -> str:
    """RFC 3339 in UTC, to the second."""
    return moment.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def timestamp_text(moment: Column) -> Column:
    """`timestamp` of a column of local times in UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def started_at(text: Column) -> Column:
    """The moment that a timestamp names, null where it is none; starts compare by it, not by their text."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX]"))


Judge = Callable[[pd.DataFrame], pd.Series]


def judged(asks: DataFrame, judge: Judge) -> DataFrame:
    """`asks` with a reply: the judge takes batches of rows and gives a reply for each, null for a failed call."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in asks.schema.fields)}, reply string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=pd.Series(list(judge(batch)), index=batch.index, dtype=object))

    return asks.mapInPandas(run, schema)


def answered(asks: DataFrame, judge: Judge, folder: str, waves: int = 16) -> DataFrame:
    """`asks` (with a column digest) with the reply to each, null where the judge gave none; replies are kept below `folder`, a shared one.

    An ask whose digest has a reply there is not put again. The others go to the judge once for each digest, in waves by digest; a wave's replies are
    written before anything reads them, so a run that is broken off loses the wave it was in and the next one asks for nothing else twice.
    Failed calls leave no reply and are asked again by the next run.
    """
    spark = asks.sparkSession
    asked = settle(asks)
    schema = "digest string, reply string"

    def known() -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    new = settle(asked.join(known().select("digest"), "digest", "left_anti").dropDuplicates(["digest"]).withColumn("_wave", F.pmod(F.xxhash64("digest"), F.lit(waves))))
    left = {r[0] for r in new.select("_wave").distinct().collect()}  # at most `waves`
    for wave in sorted(left):
        judged(new.where(F.col("_wave") == wave).drop("_wave"), judge).where("reply is not null").select("digest", "reply").write.mode("append").parquet(folder)
    replies = known().groupBy("digest").agg(F.min("reply").alias("reply"))  # of runs at the same time one reply counts
    return asked.join(replies, "digest", "left").select(*asks.columns, "reply")


def scoring_run(asks: DataFrame, judge: Judge, tables: dict[str, dict[str, int]] = score.FAULTS, folder: str | None = None) -> DataFrame:
    """item, status (scored, refused or failed), faults, refusal, value: asks (item, vocabulary, ends, texts) put to a judge once, read and priced; with a folder, by `answered` (asks have a digest)."""
    replied = settle(judged(asks, judge)) if folder is None else settle(answered(asks, judge, folder))
    read = score.parsed(replied.where("reply is not null"))
    priced = read.withColumn("value", F.when(F.col("refusal") == "", F.col("value"))).select("item", F.when(F.col("refusal") == "", "scored").otherwise("refused").alias("status"), "faults", "refusal", "value")
    failed = replied.where("reply is null").select("item", F.lit("failed").alias("status"), F.array().cast("array<string>").alias("faults"), F.lit("").alias("refusal"), F.lit(None).cast("double").alias("value"))
    return priced.unionByName(failed)


def landed(nodes: DataFrame, scored: DataFrame, hashes: DataFrame) -> DataFrame:
    """The nodes with the values of a run: scored items (item, status, value) set rigor and the hash (id, hash) that was judged, as the model's; values that people set stay."""
    own = scored.where("status = 'scored'").join(hashes.select(F.col("id").alias("item"), "hash"), "item", "left").select(F.col("item").alias("_i"), F.col("value").alias("_v"), F.col("hash").alias("_h"), F.lit(True).alias("_new"))
    joined = nodes.join(own, F.col("id") == F.col("_i"), "left")
    new = F.coalesce("_new", F.lit(False)) & ~F.coalesce("manually_scored", F.lit(False))
    put = {"rigor": F.col("_v"), "judged_hash": F.col("_h"), "manually_scored": F.lit(False)}
    return joined.select(*[F.when(new, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in nodes.columns])


def landed_edges(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """The edges with the values of a run: scored edges (relation, source, target, status, value, hash) set bearing, take the pending mark away and keep the hash that was judged, as the model's; values that people set stay, and so do relations that hold none."""
    key = ["relation", "source", "target"]
    own = scored.where("status = 'scored'").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("value").alias("_v"), F.col("hash").alias("_h"), F.lit(True).alias("_new"))
    joined = edges.join(own, [F.col(c) == F.col(f"_{c}") for c in key], "left")
    new = F.coalesce("_new", F.lit(False)) & ~F.coalesce("manually_scored", F.lit(False)) & F.col("relation").isin("supports", "founds", "lifts", "refutes")
    put = {"bearing": F.col("_v"), "bearing_pending": F.lit(False), "judged_hash": F.col("_h"), "manually_scored": F.lit(False)}
    return joined.select(*[F.when(new, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in edges.columns])


def replayed(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """vocabulary, passage, both, same_value, same_faults, same_status: how far two runs' judgements (item, vocabulary, passage, status, faults, value) agree."""
    left = recorded.select("item", "vocabulary", "passage", F.col("status").alias("s"), F.array_sort("faults").alias("f"), F.col("value").alias("v"))
    right = again.select(F.col("item").alias("_i"), F.col("status").alias("s2"), F.array_sort("faults").alias("f2"), F.col("value").alias("v2"))
    joined = left.join(right, F.col("item") == F.col("_i"))
    same = lambda a, b: F.count_if(F.col(a).eqNullSafe(F.col(b)))
    return joined.groupBy("vocabulary", "passage").agg(F.count(F.lit(1)).alias("both"), same("v", "v2").alias("same_value"), same("f", "f2").alias("same_faults"), same("s", "s2").alias("same_status"))


def run_counts(ledger: DataFrame) -> DataFrame:
    """status, n: items by the status of their last line."""
    return score.last_state(ledger).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_state(events: DataFrame) -> DataFrame:
    """stream, state, ended: what each stream's last event says: ended (done, failed or cancelled) or running."""
    last = events.groupBy("stream").agg(F.max(F.struct("ord", "kind")).alias("l"))
    over = F.col("l.kind").isin("done", "failed", "cancelled")
    return last.select("stream", F.when(over, F.col("l.kind")).otherwise("running").alias("state"), over.alias("ended"))
