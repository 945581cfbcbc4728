"""Line dedup by levelled sorted runs of line hashes.

A run is a table of 128-bit line hashes with the number of documents that hold the line and the largest of their ids, bucketed
and sorted by hash. Batches of documents come in falling order of id. Each merge-anti-joins the runs held so far and adds a run
of its own: what a run has in `min_docs` documents already is settled (no later batch can hold a larger id, and more documents
change nothing), so those lines are left out of the batch's run. As soon as a level holds `fan_in` runs they are compacted into
one run of the next level, so b batches leave O(log b) runs and a hash is rewritten O(log b) times. Runs are bucketed alike, so
that anti-joins and compactions merge bucket with bucket and shuffle no run.

Documents become hashes once (`hashed`), in DataFrame expressions; text is not shuffled for that. A line that a third of
all documents hold is one row of each task's partial aggregate, and joins split its partition (AQE).

`drop_lines` applies the corpus rule: a key of at least `min_chars` code points in at least `min_docs` documents loses all
its lines except in the largest doc_id that holds it.

Defined results: a null or empty text is one empty line; rows that repeat an id are one document, and those with the largest id
all keep the line; rows without an id are one document below all others; an empty table gives an empty result; other columns
are passed on, whatever their names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, remove, shared_dir, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """A line's key: stripped of ASCII white space, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, form (hash of the text) and keys: for each line the two hashes of its key, null where it is too short."""
    both = lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b")))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("form"), F.transform(F.transform(F.split(text_of(), "\n"), key_of), both).alias("keys"))


def lines_of(batch: DataFrame) -> DataFrame:
    """id, form, line (from 0), a and b of every line that has a key."""
    return batch.select("id", "form", F.posexplode("keys").alias("line", "k")).where("k is not null").select("id", "form", "line", F.col("k.a").alias("a"), F.col("k.b").alias("b"))


class LineRuns:
    """The levelled runs. A run has the columns a, b (hash), n_docs and last (largest id)."""

    def __init__(self, spark: SparkSession, fan_in: int = 2):
        self.spark, self.fan_in, self.levels = spark, fan_in, {}
        self.mark = uuid.uuid4().hex
        self.root = f"{shared_dir(spark).rstrip('/')}/line-runs-{self.mark}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """`df`, written below the root and read again."""
        df.write.parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, run: DataFrame) -> str:
        """A run as a table of as many buckets as shuffles have partitions, so that what is dealt by hash already isn't dealt anew."""
        name = f"argosy_lines_{self.mark}_{self.made}"
        self.made += 1
        run.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """One row for each hash of some runs, by full outer merge joins of their buckets."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnsRenamed({"n_docs": "_n", "last": "_last"})
            out = out.join(more, ["a", "b"], "full_outer").select("a", "b", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("last", "_last").alias("last"))
        return out

    @property
    def held(self) -> list[str]:
        """The runs' tables."""
        return [name for runs in self.levels.values() for name in runs]

    def totals(self) -> DataFrame | None:
        """All runs merged: one row for each hash."""
        return self._merged(self.held) if self.held else None

    def unsettled(self, own: DataFrame, min_docs: int) -> DataFrame:
        """`own` (a, b, ...) by merge-anti-join with each run: without the hashes that a run has in `min_docs` documents or more."""
        for name in self.held:
            own = own.join(self.spark.table(name).where(F.col("n_docs") >= min_docs).select("a", "b"), ["a", "b"], "left_anti")
        return own

    def add(self, batch: DataFrame, min_docs: int, again: DataFrame | None = None) -> None:
        """Makes a run of a batch of `hashed` documents, whose ids are below those of all batches before, and compacts the levels that are full.

        `again`: the ids (_again) that rows repeat, in this batch or others; pairs of such an id and a line are counted once.
        """
        own = F.sort_array(F.filter("keys", lambda k: k.isNotNull()))
        once = batch.select("id", own.alias("s")).select("id", F.explode(F.filter("s", lambda k, i: (i == 0) | (k != F.get("s", i - 1)))).alias("k")).select("id", "k.a", "k.b")
        if again is not None:
            same = F.col("id").eqNullSafe(F.col("_again"))
            once = once.join(again, same, "left_anti").unionByName(once.join(again, same, "left_semi").distinct())
        run = once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last"))
        self.levels.setdefault(0, []).append(self._write(self.unsettled(run, min_docs)))
        level = 0
        while len(self.levels.get(level, [])) >= self.fan_in:
            full = self.levels.pop(level)
            level += 1
            self.levels.setdefault(level, []).append(self._write(self._merged(full)))
            self._drop(full)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        """Drops the runs; what `keep` wrote stays."""
        self._drop(self.held)
        self.levels = {}


def falling(keyed: DataFrame, batches: int) -> list[DataFrame]:
    """`keyed` in batches of about equal size, of falling ids; rows without an id come last."""
    cuts = keyed.agg(F.percentile_approx("id", F.array(*[F.lit(1 - i / batches) for i in range(1, batches)]), F.lit(1000))).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or ()), reverse=True)
    above = [None, *cuts]
    out = [keyed.where((F.col("id") > low) if high is None else (F.col("id") > low) & (F.col("id") <= high)) for high, low in zip(above, cuts)]  # noqa: B905
    return [*out, keyed.where(F.col("id").isNull() | (F.lit(True) if above[-1] is None else F.col("id") <= above[-1]))]


def drops(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """_id, _of, _drop: for every document that loses lines, its id, its text's hash and the lines' positions in order."""
    runs = LineRuns(docs.sparkSession, fan_in)
    keyed = runs.keep(hashed(docs, min_chars), "hashed")
    again = runs.keep(keyed.groupBy(F.col("id").alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again"), "again")
    again = again if again.limit(1).count() else None
    for batch in falling(keyed, batches):
        runs.add(batch, min_docs, again)
    common = runs.keep(runs.totals().where(F.col("n_docs") >= min_docs).select("a", "b", "last"), "common")
    runs.close()
    lost = lines_of(keyed).join(common, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("last")))
    return lost.groupBy(F.col("id").alias("_id"), F.col("form").alias("_of")).agg(F.sort_array(F.collect_set("line")).alias("_drop"))


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """`docs` with its texts less the lines that the rule drops, and n_lines (before) and n_dropped."""
    lost = drops(docs, min_chars, min_docs, batches, fan_in)
    # A row's own columns travel in one struct, so no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64(text_of()).alias("_form"))
    joined = rows.join(lost, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_form") == F.col("_of")), "left")
    text = text_of("_row.text")
    # What stays are the stretches between dropped lines.
    between = F.transform("_stop", lambda stop, k: F.slice("_lines", F.coalesce(F.get("_stop", k - 1), F.lit(-1)) + 2, stop - F.coalesce(F.get("_stop", k - 1), F.lit(-1)) - 1))
    cut = (
        joined.withColumn("_lines", F.split(text, "\n"))
        .withColumn("_stop", F.concat("_drop", F.array(F.size("_lines"))))
        .withColumn("_kept", F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.flatten(between), "\n")))
    )
    own = [F.col("_kept").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*own, F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
