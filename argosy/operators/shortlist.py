"""Exact top-k cosines of TF-IDF vectors by blocks, without the pairs of common terms.

An inverted index makes df ** 2 pairs of a term of df documents. Here no pair becomes a row before it is one of a text's best in a block:

1. Texts of one bag of terms are one class; only classes are compared, and a class answers by its first ids. So copies add nothing.
2. Each text meets the heaviest `champions` texts of each of its terms. Weights aren't negative, so what they share there is a lower bound of
   their cosine, and the k-th greatest of these is a threshold: the k-th best cosine of all doesn't fall below it.
3. Classes are ordered by their number of terms and cut into blocks of `BLOCK`, so blocks of long texts have light terms throughout. A task
   takes a pair of blocks. By the greatest weight of each term in the other block it finds which texts could reach their threshold there at all; the
   products of these are summed term by term in one dense matrix of the two blocks, whatever the term's frequency, and each text's best leave the task.

A text is dealt once, to its block; pairs of blocks read it n / BLOCK times, with n classes, but no copy of it is written. Bounds have a slack of 1e-9, and what lies within 1e-11 of a block's last
place leaves it too, so roundings drop nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions import text
from argosy.operators.prefix import before
from argosy.plans.star import settle, stored

SLACK, BLOCK = 1e-9, 2048
#: Blocks are dealt to so many tasks at most, and their pairs to its square.
PARTS = 256


def term_rows(statements: DataFrame) -> DataFrame:
    """id, term, at (place of first use), tf of (id, text)."""
    found = statements.select("id", F.posexplode(text.terms_of(F.coalesce(F.col("text"), F.lit("")))).alias("at", "term"))
    return found.groupBy("id", "term").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("tf"))


def weights(terms: DataFrame, statements: DataFrame) -> DataFrame:
    """id, term, w: sublinear tf times smoothed idf, L2-normed. Norms sum in order of first use, so they don't depend on the partitioning."""
    n = statements.select("id").distinct().count()
    df = terms.groupBy(F.col("term").alias("_term")).agg(F.count(F.lit(1)).alias("df"))
    raw = terms.join(df, F.col("term") == F.col("_term")).withColumn("w", (1 + F.ln(F.col("tf").cast("double"))) * (F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = raw.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("ws"))
    norm = norm.select("_id", F.sqrt(F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])).alias("norm"))
    return raw.join(norm, F.col("id") == F.col("_id")).select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def _classes(terms: DataFrame) -> DataFrame:
    """id, rep (the least id of the same bag of terms), size."""
    bag = F.transform(F.sort_array(F.collect_list(F.struct("term", "tf"))), lambda x: F.concat(x["term"], F.lit("\x01"), x["tf"].cast("string")))
    bags = stored(terms.groupBy("id").agg(F.md5(F.encode(F.concat_ws("\x00", bag), "UTF-8")).alias("_bag")))
    reps = bags.groupBy(F.col("_bag").alias("_b")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    return bags.join(reps, F.col("_bag") == F.col("_b")).select("id", "rep", "size")


def _thresholds(v: DataFrame, needed: DataFrame, champions: int) -> DataFrame:
    """id, want, floor: what the last needed cosine of a class doesn't fall below; needed (id, want, n): n of the others it needs beside its own texts."""
    best = v.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy(F.col("w").desc(), "id"))).where(F.col("_r") <= champions)
    met = v.join(best.select("term", F.col("id").alias("b"), F.col("w").alias("_w")), "term").where("id <> b").groupBy("id", "b").agg(F.sum(F.col("w") * F.col("_w")).alias("low"))
    ranked = met.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("low").desc())))
    kth = ranked.join(needed.select("id", "n"), "id").where(F.col("_r") == F.col("n")).select("id", "low")
    return needed.join(kth, "id", "left").select("id", "want", F.when(F.col("n") <= 0, 1.0).otherwise(F.least(F.coalesce("low", F.lit(0.0)), F.lit(1.0))).alias("floor"))


def _postings(side: pa.Table) -> tuple:
    """row, term and weight of every posting, by term, and where each term begins."""
    lists = side["terms"].combine_chunks()
    rows = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    terms, weights = np.asarray(lists.flatten()), np.asarray(side["ws"].combine_chunks().flatten())
    order = np.argsort(terms, kind="stable")
    names, begins = np.unique(terms[order], return_index=True)
    return rows[order], weights[order], names, np.append(begins, len(order))


def _best_of_blocks(asking: pa.Table, held: pa.Table) -> pa.Table:
    """a, b, cosine: of each asking text its best in the other block."""
    out: tuple[list, list, list] = ([], [], [])
    if asking.num_rows and held.num_rows:
        ra, wa, ta, ia = _postings(asking)
        rb, wb, tb, ib = _postings(held)
        top = np.maximum.reduceat(wb, ib[:-1])
        common, pa_, pb_ = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
        # A text's products with the greatest weights of the block bound all of its cosines there.
        greatest = np.zeros(len(ta))
        greatest[pa_] = top[pb_]
        bound = np.bincount(ra, wa * np.repeat(greatest, np.diff(ia)), asking.num_rows)
        able = (bound >= np.asarray(asking["floor"]) - SLACK) & (bound > 0)
        scores = np.zeros((asking.num_rows, held.num_rows))
        for i, j in zip(pa_, pb_, strict=True):
            rows, weights = ra[ia[i] : ia[i + 1]], wa[ia[i] : ia[i + 1]]
            kept = able[rows]
            if kept.any():
                scores[np.ix_(rows[kept], rb[ib[j] : ib[j + 1]])] += np.outer(weights[kept], wb[ib[j] : ib[j + 1]])
        a, b, want = asking["id"].to_pylist(), held["id"].to_pylist(), np.asarray(asking["want"])
        place = {x: i for i, x in enumerate(b)}
        for i in np.flatnonzero(able):
            row = scores[i]
            if a[i] in place:
                row[place[a[i]]] = 0.0
            found = np.flatnonzero(row > 0)
            if len(found) > want[i] + 1:
                last = np.partition(row[found], len(found) - want[i] - 1)[len(found) - want[i] - 1]
                found = found[row[found] >= last - 1e-11]
            out[0].extend([a[i]] * len(found))
            out[1].extend(b[j] for j in found)
            out[2].extend(row[found].tolist())
    return pa.table({"a": pa.array(out[0], pa.string()), "b": pa.array(out[1], pa.string()), "cosine": pa.array(out[2], pa.float64())})


def _best_of_pairs(batches):
    """`_best_of_blocks` of every row's asking and held texts."""
    side = lambda x: pa.table(x.values.flatten(), names=[f.name for f in x.values.type])
    for batch in batches:
        for asking, held in zip(batch["asking"], batch["held"], strict=True):
            yield from _best_of_blocks(side(asking), side(held)).to_batches()


def near_classes(v: DataFrame, floors: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, cosine (12 decimals): for each class (id, want, floor) its want + 1 best others of each block, of vectors (id, term, w) with string ids."""
    numbers = before(v.select("term").distinct(), [F.col("term")], {"_no": 1})
    rows = v.join(numbers, "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_no", "w"))).alias("ps")).join(floors, "id")  # one text's terms
    placed = before(rows.withColumn("_n", F.size("ps")), [F.col("_n"), F.col("id")], {"_at": 1})
    placed = stored(placed.select((F.col("_at") / block).cast("int").alias("block"), "id", "want", "floor", F.col("ps._no").alias("terms"), F.col("ps.w").alias("ws")))
    conf, key = v.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = conf.get(key)
    conf.set(key, 1)  # a row is a pair of blocks
    try:
        return stored(_pairs(placed).mapInArrow(_best_of_pairs, "a string, b string, cosine double").select("a", "b", F.round("cosine", 12).alias("cosine")))
    finally:
        conf.set(key, kept)


def _pairs(placed: DataFrame) -> DataFrame:
    """asking, held: every pair of blocks, each an array of its texts. A block is dealt once, and read again for each other."""
    blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    texts = placed.repartition(min(blocks, PARTS), "block").groupBy("block").agg(F.collect_list(F.struct("id", "want", "floor", "terms", "ws")).alias("texts"))
    return texts.select(F.col("texts").alias("asking")).crossJoin(texts.select(F.col("texts").alias("held")))


def top_cosines(statements: DataFrame, k: int, shut: DataFrame, champions: int = 4, block: int = BLOCK) -> DataFrame:
    """a, b, cosine, rank: each text's k best others with a common term, ties by id, less the pairs in `shut` (a, b: both ways)."""
    terms = stored(term_rows(statements))
    members = stored(_classes(terms))
    v = stored(weights(terms, statements).join(members.where("id = rep").select("id"), "id", "left_semi"))
    # As many more as a text has pairs shut, and one that may be itself.
    closed = shut.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("_shut"))
    counts = members.join(closed, "id", "left").groupBy(F.col("rep").alias("id")).agg(F.first("size").alias("size"), (F.coalesce(F.max("_shut"), F.lit(0)) + k).alias("want"))
    counts = settle(counts.withColumn("n", F.greatest(F.col("want") - F.col("size") + 1, F.lit(0))))
    found = near_classes(v, _thresholds(v, counts, champions), block)
    own = counts.where("size > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    order = lambda by, target: Window.partitionBy(by).orderBy(F.col("cosine").desc(), target)
    near = found.unionByName(own).withColumn("_r", F.row_number().over(order("a", "b"))).join(counts.select(F.col("id").alias("a"), "want"), "a").where(F.col("_r") <= F.col("want") + 1)
    most = (counts.agg(F.max("want")).first()[0] or k) + 1
    first = members.withColumn("_m", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("_m") <= most).select(F.col("rep").alias("b"), F.col("id").alias("_t"))
    answers = near.select("a", "b", "cosine", "want").join(first, "b").withColumn("_r", F.row_number().over(order("a", "_t"))).where(F.col("_r") <= F.col("want") + 1)
    each = members.select("id", "rep").join(answers.select(F.col("a").alias("rep"), "_t", "cosine"), "rep").where("id <> _t").select(F.col("id").alias("a"), F.col("_t").alias("b"), "cosine")
    return each.join(shut, ["a", "b"], "left_anti").withColumn("rank", F.row_number().over(order("a", "b"))).where(F.col("rank") <= k)
