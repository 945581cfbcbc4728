"""Strength: a topological fold over the scoring edges.

A round folds every node whose sources all have values: premises by min, lifts by max, refutations as caps. A value that isn't there yet
is not the same as a pending one, so nothing is folded early; what never becomes ready lies on a cycle or rests on one, and
derives nothing. A round settles the open nodes with what has landed on them, and the edges into those that stay open; edges of settled
targets leave the frontier, so the work over all rounds is one join for each edge and level.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosy.functions.graph import contribution, display, scoring
from argosy.plans.star import participants, stored


def fold(kind: Column, rigor: Column, premise: Column, lift: Column, cap: Column) -> Column:
    """min(max(derivation, lift), cap). A bare claim derives 0, a bare analysis its rigor; a pending rigor under premises stays pending."""
    derived = derivation(kind, rigor, premise)
    held = F.greatest(derived, lift)  # skips nulls
    return F.when(held.isNotNull() & cap.isNotNull(), F.least(held, cap)).otherwise(held)


def derivation(kind: Column, rigor: Column, premise: Column) -> Column:
    bare = F.when(kind == "claim", F.lit(0.0)).otherwise(rigor)
    return F.when(premise.isNull(), bare).when(rigor.isNotNull(), F.least(rigor, premise))


def stations(landing: DataFrame) -> DataFrame:
    """id, premise, lift, cap over edges (target, relation, worth)."""
    of = lambda *names: F.when(F.col("relation").isin(*names), F.col("worth"))
    return landing.groupBy(F.col("target").alias("id")).agg(F.min(of("supports", "founds")).alias("premise"), F.max(of("lifts")).alias("lift"), F.min(of("refutes")).alias("cap"))


def folded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, premise, lift, cap, strength, level of every claim and analysis; strength and level are null on and above cycles."""
    left = stored(nodes.where(F.col("kind").isin("claim", "analysis")).select("id", "kind", "rigor"))
    sources = participants(nodes).select(F.col("id").alias("_p"), F.col("rigor").alias("_value"))
    walk = edges.where(scoring(F.col("relation"))).select("relation", "source", "target", "bearing")
    # Sources outside seats and participants (planned experiments, unknown ids) are no part of the walk.
    joined = walk.join(sources, F.col("source") == F.col("_p"), "left").join(left.select(F.col("id").alias("_s")), F.col("source") == F.col("_s"), "left").where("_p is not null or _s is not null")
    worth = lambda value: contribution(F.col("relation"), F.col("bearing"), F.col(value))
    waits = F.col("_p").isNull()
    state = stored(joined.select("relation", "source", "target", "bearing", waits.alias("open"), F.when(~waits, worth("_value")).alias("worth")))
    done, level = [], 1
    while True:
        waiting = state.where("open").select(F.col("target").alias("_w")).distinct()
        landed = stations(state.where("not open")).withColumnRenamed("id", "_i")
        marked = left.join(waiting, F.col("id") == F.col("_w"), "left").join(landed, F.col("id") == F.col("_i"), "left")
        marked = stored(marked.select("id", "kind", "rigor", "premise", "lift", "cap", F.col("_w").isNull().alias("ready")))
        counts = marked.agg(F.count_if("ready"), F.count_if(~F.col("ready"))).first()
        left = marked.where("not ready").select("id", "kind", "rigor")
        if not counts[0]:
            break
        found = marked.where("ready").select("id", "premise", "lift", "cap", fold(F.col("kind"), F.col("rigor"), F.col("premise"), F.col("lift"), F.col("cap")).alias("strength"), F.lit(level).alias("level"))
        done.append(found)
        if not counts[1]:
            return functools.reduce(DataFrame.unionByName, done)
        # Only edges into nodes still open are needed again; those from what is found are settled.
        state = state.join(left.select(F.col("id").alias("_l")), F.col("target") == F.col("_l"), "left_semi").join(found.select(F.col("id").alias("_v"), F.col("strength").alias("_value")), F.col("source") == F.col("_v"), "left")
        fresh = F.col("open") & F.col("_v").isNotNull()
        state = stored(state.select("relation", "source", "target", "bearing", (F.col("open") & F.col("_v").isNull()).alias("open"), F.when(fresh, worth("_value")).otherwise(F.col("worth")).alias("worth")))
        level += 1
    none = [F.lit(None).cast("double").alias(c) for c in ("premise", "lift", "cap", "strength")]
    return functools.reduce(DataFrame.unionByName, [*done, left.select("id", *none, F.lit(None).cast("int").alias("level"))])


def derive(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes with premise, lift, cap, strength (rigor where nothing is derived) and dependents (distinct targets)."""
    values = folded(nodes, edges).select(F.col("id").alias("_id"), "premise", "lift", "cap", F.col("strength").alias("_strength"), "level")
    used = edges.where(scoring(F.col("relation"))).select("source", "target").distinct().groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("dependents"))
    derived = F.col("kind").isin("claim", "analysis")
    return (
        nodes.join(values, F.col("id") == F.col("_id"), "left")
        .join(used, F.col("id") == F.col("_source"), "left")
        .withColumn("strength", F.when(derived, F.col("_strength")).otherwise(F.col("rigor")))
        .withColumn("dependents", F.coalesce("dependents", F.lit(0)).cast("long"))
        .drop("_id", "_source", "_strength")
    )


def trace_text(nodes: DataFrame) -> DataFrame:
    """id and how the strength came about: min(max(min(rigor, premise), lift), cap), empty where nothing composes it."""
    r, p, up, cap = (F.col(c) for c in ("rigor", "premise", "lift", "cap"))
    derived = derivation(F.col("kind"), r, p)
    core = F.when(p.isNotNull() & r.isNotNull(), F.concat(F.lit("min("), display(r), F.lit(", "), display(p), F.lit(")"))).when(derived.isNotNull(), display(derived))
    lifted = F.when(up.isNull(), core).when(r.isNull(), F.concat(F.lit("lift "), display(up))).otherwise(F.concat(F.lit("max("), F.coalesce(core, F.lit("")), F.lit(", "), display(up), F.lit(")")))
    capped = F.when(cap.isNotNull() & F.col("strength").isNotNull(), F.concat(F.lit("min("), lifted, F.lit(", "), display(cap), F.lit(")"))).otherwise(F.when(up.isNotNull() | p.isNotNull(), lifted))
    return nodes.where(F.col("kind").isin("claim", "analysis")).select("id", F.coalesce(capped, F.lit("")).alias("trace"))
