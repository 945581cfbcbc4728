"""Structured Streaming over the ledger: last states by key, idempotent folds, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.sources.records import LEDGER_SCHEMA


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    """New attempt lines as files arrive."""
    return spark.readStream.schema(LEDGER_SCHEMA).json(path)


def once(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Attempt lines, each once: repeats of (item, started, ended, digest) within the delay are dropped, with bounded state."""
    return stream.withColumn("at", F.to_timestamp("ended")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["item", "started", "ended", "digest"])


def last_states(stream: DataFrame) -> DataFrame:
    """Each item's last line by end time; run it in complete or update mode."""
    return stream.groupBy("item").agg(F.max_by(F.struct("status", "value"), F.struct("ended", "digest")).alias("s")).select("item", "s.status", "s.value")


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts of events (ts, event_type) by tumbling window; late rows within the delay count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
