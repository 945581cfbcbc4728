"""States of runs over restarts, repeats, late and silent runs, against the batch query."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from argosy.operators import asks
from argosy.streaming import runs

EVENT = "stream string, ord long, kind string, at timestamp"


def test_stream_states_equal_the_batch_query(spark, tmp_path):
    rng = random.Random(81)
    kinds = ["started", "progress", "progress", "done", "failed", "cancelled"]
    events = [(f"r{i}", n, rng.choice(kinds if n else kinds[:1]), f"2024-01-01 {10 + n // 60:02d}:{n % 60:02d}:00") for i in range(12) for n in range(rng.randrange(1, 20))]
    events += [(None, 1, "done", "2024-01-01 10:00:00"), ("odd", None, "done", "2024-01-01 10:00:00"), ("odd", 2, None, "2024-01-01 10:00:00"), ("r3", 500, "cancelled", "2024-01-01 10:30:00")]
    rows = events + rng.sample(events, 30)  # repeats
    rng.shuffle(rows)
    source, folder, state = (str(tmp_path / x) for x in ("source", "updates", "state"))
    stream = lambda: spark.readStream.schema(EVENT).parquet(source)
    write = lambda part: spark.createDataFrame(part, "stream string, ord long, kind string, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(source)
    third = len(rows) // 3
    for i in range(3):
        write(rows[i * third : (i + 1) * third if i < 2 else len(rows)])
        runs.run(stream(), folder, state, delay="10 hours", idle=36_000_000)
        seen = spark.read.schema(EVENT).parquet(source).where("stream is not null and ord is not null and kind is not null")
        want = sorted(tuple(r) for r in asks.run_state(seen).select("stream", "state", "ended").collect())
        assert sorted((r.stream, r.state, r.ended) for r in runs.latest(spark, folder).collect()) == want
    again = spark.read.parquet(f"{folder}/{0:012d}")
    kept = sorted(map(tuple, runs.latest(spark, folder).collect()))
    runs.write_batch(spark.createDataFrame(again.drop("batch").collect(), runs.UPDATE), 0, folder)  # a batch that is run again
    assert sorted(map(tuple, runs.latest(spark, folder).collect())) == kept


def test_silent_runs_are_marked_and_come_back(spark, tmp_path):
    source, folder, state = (str(tmp_path / x) for x in ("source", "updates", "state"))

    def step(*rows):
        spark.createDataFrame(rows, "stream string, ord long, kind string, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(source)
        runs.run(spark.readStream.schema(EVENT).parquet(source), folder, state, delay="1 minute", idle=600_000, keep=1_200_000)
        return {r.stream: (r.state, r.silent) for r in runs.latest(spark, folder).collect()}

    assert step(("a", 1, "started", "2024-01-01 10:00:00"), ("b", 1, "done", "2024-01-01 10:00:00")) == {"a": ("running", False), "b": ("done", False)}
    assert step(("c", 1, "started", "2024-01-01 11:00:00")) == {"a": ("running", True), "b": ("done", False), "c": ("running", False)}
    assert step(("a", 2, "progress", "2024-01-01 11:05:00"))["a"] == ("running", False)
    assert step(("a", 3, "done", "2024-01-01 11:06:00"))["a"] == ("done", False)
