"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of `window` consecutive words (a shorter item is one window), a window into shingles of five
words (a shorter window is one shingle). Shingles are ordered by rarity: by their number in all documents. To hold at least `need` of a
window's m shingles in their places, a stretch of a document must hold one of its m - need + 1 rarest; only these join. A match gives the
stretch's place; it has to start within the document (positional bound) and leave room for the window (length bound). What is
left is verified exactly: the window's shingles are joined with the document's at their places and counted.

Documents are read once. Each marks the places whose shingle falls into a bucket of the benchmark's: buckets are one bit map of fixed size
(2**18 bytes), the only thing that travels to all tasks. Marked shingles then join the benchmark's by their words. Copies of a text are
one text from there on, so a group of copies adds rows to no join but the last, by text hash, which AQE can split.

Defined results: a null text has no words; rows that repeat, or share an id, are rows of their own; an item without words has no
windows; items that share an id are one; a null item id is shown as `null`; other columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, text_of

#: A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE, BUCKETS = 5, 2**18


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _taken(words: Column, at: Column, size: int) -> list[Column]:
    """`size` words from a place (from 0), each by its index: slices copy the whole array."""
    return [F.get(words, at + j) for j in range(size)]


def _bucket(words: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS))


def _starts(words: Column, size: int) -> Column:
    """Places (from 0) of all runs of `size` words; the first alone if there are fewer."""
    return F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))


def windows(items: DataFrame, window: int) -> DataFrame:
    """item (its id as text), window (its words joined by spaces), n (its words), grams (array): each item's windows."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(text_of()).alias("_w")).where(F.size("_w") > 0)
    cut = cut.select("item", F.explode(F.transform(_starts(F.col("_w"), window), lambda i: F.filter(F.array(*_taken(F.col("_w"), i, window)), lambda w: w.isNotNull()))).alias("_w"))
    grams = F.transform(_starts(F.col("_w"), SHINGLE), lambda i: F.concat_ws(" ", *_taken(F.col("_w"), i, SHINGLE)))  # words hold no spaces
    return cut.select("item", F.array_join("_w", " ").alias("window"), F.size("_w").alias("n"), grams.alias("grams")).distinct()


def _marked(docs: DataFrame, grams: DataFrame, id_col: str) -> DataFrame:
    """_id, _key (the text's hash), n_words and marks (array of at, gram): places whose shingle falls into a bucket of the benchmark's."""
    bucket = F.coalesce(*[F.when(F.size("_g") == n, _bucket(_taken(F.col("_g"), F.lit(0), n))) for n in range(1, SHINGLE + 1)])
    held = grams.select(F.split("gram", " ").alias("_g")).select(F.size("_g").alias("size"), bucket.alias("bucket")).distinct().collect()  # at most BUCKETS of each of five sizes
    bits = bytearray(BUCKETS)
    for r in held:
        bits[r.bucket] = 1
    bitmap, one = F.lit(bytes(bits)), F.lit(b"\x01")

    def marks(size: int) -> Column:
        hit = F.filter(_starts(F.col("_w"), size), lambda i: F.substring(bitmap, (_bucket(_taken(F.col("_w"), i, size)) + 1).cast("int"), F.lit(1)) == one)
        return F.when(F.size("_w") >= size, F.transform(hit, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", *_taken(F.col("_w"), i, size)).alias("gram"))))

    none = F.array().cast("array<struct<at: int, gram: string>>")
    found = F.concat(none, *[F.coalesce(marks(s), none) for s in sorted({r.size for r in held})])
    read = docs.select(F.col(id_col).alias("_id"), text_of().alias("_text")).select("_id", F.unhex(F.md5(F.encode("_text", "UTF-8"))).alias("_key"), words(F.col("_text")).alias("_w"))
    return read.select("_id", "_key", F.size("_w").alias("n_words"), found.alias("marks"))


def _occurrences(marked: DataFrame, cut: DataFrame, share: float) -> DataFrame:
    """_key, window, start, n: where texts hold at least `share` of a window's shingles in their places."""
    whole = cut.select("window", "n", "grams").distinct()
    held = whole.select("window", "n", "grams", F.posexplode("grams").alias("offset", "gram"))
    places = marked.select("_key", "n_words", F.explode("marks").alias("m")).select("_key", "n_words", "m.at", "m.gram")
    found = settle(places.join(held.select("gram").distinct(), "gram", "left_semi").dropDuplicates(["_key", "at", "gram"]))
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("rarity"))
    need = F.ceil(F.lit(share) * F.size("grams"))
    rank = F.row_number().over(Window.partitionBy("window").orderBy("rarity", "gram", "offset"))  # at most a window's shingles
    prefix = held.join(counts, "gram", "left").withColumn("rarity", F.coalesce("rarity", F.lit(0))).withColumn("_rank", rank).where(F.col("_rank") <= F.size("grams") - need + 1)
    start = F.col("at") - F.col("offset")
    near = found.join(prefix.select("gram", "offset", "window", "n", "grams"), "gram").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    near = near.select("_key", "window", start.alias("start"), "n", "grams").dropDuplicates(["_key", "window", "start"])
    parts = near.select("_key", "window", "start", "n", need.alias("need"), F.posexplode("grams").alias("offset", "gram")).withColumn("at", F.col("start") + F.col("offset"))
    met = parts.join(found.select("_key", "at", "gram"), ["_key", "at", "gram"], "left_semi").groupBy("_key", "window", "start", "n").agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need"))
    return met.where("met >= need").select("_key", "window", "start", "n")


def _by_text(occurrences: DataFrame, cut: DataFrame) -> DataFrame:
    """_key, spans (disjoint word spans start, stop, in order), items (sorted ids as text)."""
    order = Window.partitionBy("_key").orderBy("start", "stop")  # a text's own matches: at most its words times the lengths of windows
    ends = occurrences.select("_key", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    ends = ends.withColumn("_before", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_island", F.sum(F.when(F.col("start") <= F.col("_before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = ends.groupBy("_key", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    items = occurrences.select("_key", "window").distinct().join(cut.select("window", "item").distinct(), "window").groupBy("_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return spans.join(items, "_key")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, share: float = 1.0, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_words, spans (disjoint word spans start, stop that occur in the benchmark), items (ids as text, sorted), contaminated; a row for each of docs (id_col, text).

    `items` has item_id and text. A window occurs where a document has `share` of its shingles in their places (1: all of its words).
    """
    if not 0 < share <= 1 or window < 1:
        raise ValueError("a share is above 0 and at most 1, a window has a word or more")
    cut = settle(windows(items, window))
    marked = settle(_marked(docs, cut.select(F.explode("grams").alias("gram")).distinct(), id_col))
    found = _by_text(settle(_occurrences(marked, cut, share)), cut)
    rows = marked.drop("marks").join(found, "_key", "left")
    return rows.select(
        F.col("_id").alias(id_col), F.col("n_words").cast("long"), F.coalesce("spans", F.array().cast("array<struct<start: int, stop: int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, share: float = 1.0) -> DataFrame:
    """The rows of `docs` (with a column `text`) in which no window occurs."""
    cut = settle(windows(items, window))
    marked = settle(_marked(docs.select(F.lit(0).alias("_id"), "text"), cut.select(F.explode("grams").alias("gram")).distinct(), "_id"))  # a filter here would be pushed down, and take the words anew for every place
    hit = _occurrences(marked, cut, share).select(F.col("_key").alias("_hit")).distinct()
    return docs.join(hit, F.unhex(F.md5(F.encode(text_of(), "UTF-8"))) == F.col("_hit"), "left_anti")
