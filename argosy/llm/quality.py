"""Risk-controlled quality rules: cutoffs that labelled holdouts certify.

Rules reject a text whose signal (share of symbols, of repeated lines, of repeated words, mean word length) is above a
cutoff. Cutoffs come from a fixed grid and are tested from the laxest to the strictest. With n good labelled rows of a
stratum, k of them above the cutoff, the exact binomial bound P(Bin(n, risk) <= k) has to be at most
delta / (signals * strata); the sequence stops at the first failure. Strata with fewer good labels than any certificate needs
share a pool, whose cutoffs are certified and used for all of them. So, with probability 1 - delta, no certified cutoff of
any signal in any stratum rejects more than `risk` of the good rows, and all signals together reject at most
signals * risk. Of the certified cutoffs, the one that parts bad from good rows best is used, the laxest of equals; none
if nothing is certified or nothing is won. All labelled rows count; all of it is DataFrame operations.

The binomial sum starts at k and goes down for 12 standard deviations and 60 terms; what is left out is below 1e-30 of it.
Repeats of a three-word window are found by its 64-bit hash within one text.

Defined results: a null or empty text has no words and fails the base rule; labels other than 0 and 1, and labels without a
document, count for nothing; a document labelled several times counts once, as the least of its labels, and rows that repeat an id
count once; languages outside `strata`, and null, share a stratum; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, settle, text_of

STRATA = ("en", "de", "fr", "es")
#: The strata of all other languages, and of strata with too few good labels of their own.
OTHER, POOL = "other", "pool"
#: Grid of each signal: cutoffs j * step for j in 0 .. STEPS - 1.
STEPS = 64
GRID = {"symbols": 1 / 64, "dup_lines": 1 / 64, "repeat_words": 1 / 64, "word_length": 0.5}


def base_signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text, trimmed = F.col("_text"), F.trim(F.col("_text"), F.lit(SPACE_CHARS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gram = lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))
    twice = lambda x, k: (x["h"] == F.get("_grams", k - 1)["h"]) | (x["h"] == F.get("_grams", k + 1)["h"])
    fresh = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3))))
    return (
        docs.select("doc_id", "lang", text_of().alias("_text"))
        .select("doc_id", "lang", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")).alias("_words"), lines.alias("_lines"), F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
        .select(
            "doc_id", "lang", "n_symbols", "_words",
            F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        )
        .withColumn("_grams", F.sort_array(F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), gram)))
        .withColumn("_at", F.sort_array(F.transform(F.filter("_grams", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])))
        .withColumn("n_repeat_words", F.aggregate(fresh, F.lit(0), lambda a, x: a + x).cast("long"))
        .drop("_words", "_grams", "_at")
    )


def failed(counts: DataFrame, min_words: int = 50, repeat_percent: int = 50) -> Column:
    """The base rule: too few words, or too many in repeated windows."""
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > repeat_percent * counts["n_words"])


def _signal(name: str) -> Column:
    over, of = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeat_words": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}[name]
    return F.when(F.col(of) > 0, F.col(over) / F.col(of)).otherwise(F.lit(0.0))


def _stratum(strata: Sequence[str]) -> Column:
    return F.when(F.col("lang").isin(*strata), F.col("lang")).otherwise(F.lit(OTHER))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series at x + 8; within 1e-12."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    shift = F.ln(x)
    for i in range(1, 8):
        shift = shift + F.ln(x + i)
    return series - shift


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), and 1 where k is at or above the mean."""
    kd, nd = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(risk) + (nd - kd) * math.log1p(-risk))
    terms = F.least(kd, F.ceil(12 * F.sqrt(nd * risk)) + 60).cast("int")
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def down(a: Column, i: Column) -> Column:
        term = a["term"] * (kd - i) / (nd - kd + i + 1) * ((1 - risk) / risk)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    summed = F.aggregate(F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>")), zero, down)["sum"]
    return F.when((nd > 0) & (kd < nd * risk), summed).otherwise(F.lit(1.0))


def needed(risk: float, level: float) -> int:
    """The fewest good labels with which a cutoff that rejects none of them can be certified: (1 - risk) ** n <= level."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def holdout(counts: DataFrame, labels: DataFrame, least: int, strata: Sequence[str]) -> DataFrame:
    """stratum, pooled, quality and the signals of every labelled document, once each.

    Strata with fewer than `least` good labels are pooled: that rule looks at counts of labels alone, so bounds hold for the pool as
    for any stratum. A document's least label counts, and of rows that repeat its id the greatest signals and the first stratum.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_labelled")).agg(F.min("quality").alias("quality"))
    once = counts.select("doc_id", _stratum(strata).alias("_s"), *[_signal(s).alias(s) for s in GRID]).join(marked, F.col("doc_id") == F.col("_labelled"))
    once = settle(once.groupBy("doc_id").agg(F.min("_s").alias("_s"), F.min("quality").alias("quality"), *[F.max(s).alias(s) for s in GRID]))
    own = once.groupBy(F.col("_s").alias("stratum")).agg(F.sum("quality").alias("n")).where(F.col("n") >= least)
    return once.join(F.broadcast(own.select("stratum")), F.col("_s") == F.col("stratum"), "left").select(F.coalesce("stratum", F.lit(POOL)).alias("stratum"), "quality", *GRID)  # a row for each stratum


def certify(held: DataFrame, risk: float, level: float, strata: Sequence[str]) -> DataFrame:
    """stratum, signal, step, n_good, n_bad, n_false, p_value, certified, gain: one row for each point of the grid."""
    names, all_of = list(GRID), [*strata, OTHER, POOL]
    binned = F.array(*[F.struct(F.lit(s).alias("signal"), F.least(F.lit(STEPS), F.ceil(F.col(s) / GRID[s])).cast("int").alias("bin")) for s in names])
    found = (
        held.select("stratum", "quality", F.explode(binned).alias("_x"))
        .groupBy("stratum", F.col("_x.signal").alias("signal"), F.col("_x.bin").alias("bin"))
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    )
    grid = held.sparkSession.range(len(all_of) * len(names) * (STEPS + 1)).select(
        F.element_at(F.array(*map(F.lit, all_of)), (F.col("id") % len(all_of) + 1).cast("int")).alias("stratum"),
        F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("id") / len(all_of)) % len(names) + 1).cast("int")).alias("signal"),
        F.floor(F.col("id") / (len(all_of) * len(names))).cast("int").alias("bin"),
    )
    cell = Window.partitionBy("stratum", "signal")
    above, laxer = cell.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1), cell.orderBy(F.col("bin").desc())
    sums = grid.join(found, ["stratum", "signal", "bin"], "left").fillna(0, ["good", "bad"])
    # A value in bin b is above the cutoffs below b; so cutoff j rejects what lies in bins above j.
    sums = sums.select("stratum", "signal", F.col("bin").alias("step"), F.col("bin"), F.sum("good").over(cell).alias("n_good"), F.sum("bad").over(cell).alias("n_bad"), F.coalesce(F.sum("good").over(above), F.lit(0)).alias("n_false"), F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("n_true"))
    tested = sums.where(F.col("step") < STEPS).withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), risk))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return tested.withColumn("certified", F.max("p_value").over(laxer) <= level).withColumn("gain", share("n_true", "n_bad") - share("n_false", "n_good")).drop("bin")


def choose(tested: DataFrame) -> DataFrame:
    """stratum, signal, cutoff: the certified step of the greatest gain, the laxest of equals."""
    best = tested.where(F.col("certified") & (F.col("gain") > 0)).groupBy("stratum", "signal").agg(F.max(F.struct("gain", "step"))["step"].alias("step"))
    step = F.create_map(*[F.lit(x) for pair in GRID.items() for x in pair])
    return best.select("stratum", "signal", (F.col("step") * F.element_at(step, F.col("signal"))).alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.005, delta: float = 0.05, strata: Sequence[str] = STRATA) -> DataFrame:
    """doc_id, lang, the counts of each text, stratum (the pool where its own has too few labels), n_holdout (its good labels), cutoff_<signal> (null: none), base_failed and kept."""
    counts = settle(base_signals(docs))
    level = delta / (len(GRID) * (len(strata) + 2))
    held = holdout(counts, labels, needed(risk, level), strata)
    tested = settle(certify(held, risk, level, strata))
    # (strata + 2) * signals rows at most: sizes fixed by the parameters.
    cutoffs = {(r.stratum, r.signal): r.cutoff for r in choose(tested).collect()}
    sizes = {r.stratum: r.n for r in tested.groupBy("stratum").agg(F.max("n_good").alias("n")).collect()}
    stratum = F.when(_stratum(strata).isin(*[s for s, n in sizes.items() if n and s != POOL]), _stratum(strata)).otherwise(F.lit(POOL))
    of = lambda values, kind: F.element_at(F.create_map(*[x for s in (*strata, OTHER, POOL) for x in (F.lit(s), F.lit(values.get(s)).cast(kind))]), F.col("stratum"))
    out = counts.withColumn("stratum", stratum).withColumn("n_holdout", of(sizes, "long"))
    for signal in GRID:
        out = out.withColumn(f"cutoff_{signal}", of({s: c for (s, name), c in cutoffs.items() if name == signal}, "double"))
    rejected = functools.reduce(lambda a, b: a | b, [F.coalesce(_signal(s) > F.col(f"cutoff_{s}"), F.lit(False)) for s in GRID])
    return out.withColumn("base_failed", failed(counts)).withColumn("kept", ~F.col("base_failed") & ~rejected)
