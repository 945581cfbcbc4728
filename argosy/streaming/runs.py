"""States of runs from their progress events, as a stream: any order, repeats, late rows, restarts, runs that fall silent.

Each run keeps its greatest event (ord, then kind), so the state is the same whatever the order of arrival and however often an event comes. A timer in event time
marks a run that is still going and has been silent for `idle`; the next event takes the mark away. Ended runs are let go `keep` after their last event.

Updates go to a folder for each batch id, which a batch that is run again overwrites, so every update counts exactly once. `latest` reads the last of each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDED = ("done", "failed", "cancelled")
UPDATE = "stream string, ord long, state string, ended boolean, silent boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunStates(StatefulProcessor):
    """The state of one run: its greatest event and when it came."""

    def __init__(self, idle: int, keep: int):
        self.idle, self.keep = idle, keep  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ord long, kind string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best, at = (held[0], held[1]) if held else None, held[2] if held else 0
        seen = best
        for batch in rows:
            events = batch.dropna(subset=["ord", "kind"])
            for ord_, kind, ts in zip(events["ord"], events["kind"], events["at"], strict=True):
                event = (int(ord_), str(kind))
                best = event if best is None or event > best else best
                at = max(at, int(pd.Timestamp(ts).timestamp() * 1000))
        if best is None:
            return
        self.last.update((*best, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + (self.keep if best[1] in ENDED else self.idle))
        if best != seen:
            yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            ord_, kind, _ = self.last.get()
            if kind in ENDED:
                self.last.clear()
            else:
                yield self._row(key, (ord_, kind), True)

    def _row(self, key, event: tuple, silent: bool) -> pd.DataFrame:
        ended = event[1] in ENDED
        return pd.DataFrame({"stream": [key[0]], "ord": [event[0]], "state": [event[1] if ended else "running"], "ended": [ended], "silent": [silent]})

    def close(self) -> None:
        pass


def states(events: DataFrame, delay: str = "1 hour", idle: int = 600_000, keep: int = 86_400_000) -> DataFrame:
    """stream, ord, state, ended, silent: updates of a stream of events (stream, ord, kind, at), rows late by up to `delay` included."""
    held = events.select(F.col("stream").cast("string").alias("stream"), F.col("ord").cast("long").alias("ord"), "kind", "at").where("stream is not null").withWatermark("at", delay)
    return held.groupBy("stream").transformWithStateInPandas(RunStates(idle, keep), UPDATE, "Update", "EventTime")


def run(events: DataFrame, folder: str, checkpoint: str, **options) -> None:
    """Takes in all that has arrived and writes the updates below `folder`; both paths are shared ones, and the next call goes on where this one ended."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # timers and several states need it
    try:
        query = states(events, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, batch: write_batch(df, batch, folder)).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def write_batch(updates: DataFrame, batch: int, folder: str) -> None:
    """A batch's updates under its id: written again, they replace themselves."""
    updates.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/{batch:012d}")


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """stream, ord, state, ended, silent: the last update of each run."""
    held = spark.read.schema(f"{UPDATE}, batch long").parquet(f"{folder}/*")
    return held.groupBy("stream").agg(F.max_by(F.struct("ord", "state", "ended", "silent"), F.struct("batch", "silent")).alias("u")).select("stream", "u.*")
