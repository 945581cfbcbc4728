"""Queries that run a stream over the events to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.plans.judging import _KIND
from argosy.plans.registry import ORACLES, QUERIES
from argosy.plans.star import settle
from argosy.streaming import runs


def stream_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark.range(1))  # the session has a shared folder from here on
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/runs-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    runs.run(events.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), F.expr(_KIND).alias("kind"), F.col("ts").cast("timestamp").alias("at")), f"{root}/updates", f"{root}/state", delay="36500 days", idle=10**15, keep=10**15)
    return runs.latest(spark, f"{root}/updates").select("stream", "ord", "state", "ended")


QUERIES["stream_run_states"] = stream_run_states
ORACLES["stream_run_states"] = f"""select user_id::varchar as stream, event_id as ord, case when k in ('done', 'failed', 'cancelled') then k else 'running' end as state, k in ('done', 'failed', 'cancelled') as ended
  from (select user_id, event_id, {_KIND} as k from events qualify row_number() over (partition by user_id order by event_id desc) = 1)"""
