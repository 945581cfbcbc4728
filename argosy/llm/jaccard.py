"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Each whole text becomes its set of word n-grams (64-bit hashes) and, from it, a 128-bit form (equal sets have equal forms),
   and one hash for each band of a MinHash signature. Band and row counts are chosen for the target recall at the threshold.
2. Copies are folded: one row for each form, with its number of documents and least doc_id. All that follows is on forms.
3. Forms are shuffled on band hashes. Each bucket links its members to its least member (n - 1 edges, not all pairs), and the
   connected components of these edges hold every pair that shares a bucket.
4. A component's full n-gram sets meet in blocks of about `block` forms and 2 million n-grams at most: every pair of blocks is one task that verifies all
   its pairs by tiled matrix products over shared n-grams and returns, for each form, its number of links and the root of its
   verified group. Small components share a task. So no pair is ever emitted, none is left out, and no group meets in one task.
   A large component that false candidates chain together is verified bucket by bucket instead, each pair in the first bucket that
   it shares, where that means fewer pairs: the work follows the buckets' pairs, not the square of the chain.
5. Verified groups that span blocks are joined by connected components; documents get the least doc_id of their group.

Defined results: a text of 1 to n - 1 words has one n-gram of all its words; a null or empty text, or one of white space, is alone;
a null doc_id takes part but never names a class unless its whole class has null ids; rows that repeat an id each count as a
document; an empty table gives an empty result; other columns are ignored (`near_duplicates`) or passed on (`one_of_each`),
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.operators.components import components

from .common import held, settle, small_batches, text_of

BLOCK, GRAMS = 1024, 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MAX_HASHES = 128


def bands_for(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) with 1 - (1 - t**rows)**bands >= recall in `most` hashes."""
    fits = [(b, r) for r in range(1, most + 1) if threshold**r > 1e-12 and (b := max(1, math.ceil(math.log1p(-recall) / math.log1p(-(threshold**r))))) * r <= most]
    if not fits:
        raise ValueError("no banding of so few hashes reaches the recall")
    return max(fits, key=lambda x: x[1])


def _words(text: str, known: dict) -> np.ndarray:
    """64-bit hashes of the words; bytes.split() parts at the same white space as the pattern for words."""
    parts = text.encode("utf-8", "surrogatepass").split()
    if len(known) > 100_000:
        known.clear()
    get, out = known.get, []
    for w in parts:
        h = get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def gram_set(text: str, n: int, known: dict) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams."""
    w = _words(text, known)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h * MIX) ^ w[i : len(w) - k + 1 + i]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def band_hashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> list[int]:
    """One 64-bit hash for each band of the MinHash signature."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        least = np.minimum(least, (grams[at : at + 1024, None] * a + b).min(axis=0))
    raw = least.tobytes()
    width = len(raw) // bands
    return [xxhash.xxh64_intdigest(raw[i * width : (i + 1) * width], seed=i) - 2**63 for i in range(bands)]


def sketches(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, text_hash, form, n_grams and bands of every document; form and bands are null where there are no n-grams."""
    docs = small_batches(docs).select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("_text"))
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, bands * rows, np.uint64)

    def run(batches):
        known = held("jaccard", dict)
        for batch in batches:
            forms, sizes, keys = [], [], []
            for text in batch.column(2).to_pylist():
                grams = gram_set(text, n, known)
                forms.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                sizes.append(len(grams))
                keys.append(band_hashes(grams, a, b, bands) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "form", "n_grams", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, form binary, n_grams long, bands array<bigint>")


def buckets(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """form, band, key of every form's buckets; and key, hub (its least form), size of the buckets of two forms or more."""
    held = settle(forms.select("form", F.posexplode("bands").alias("band", "h")).select("form", "band", F.xxhash64("band", "h").alias("key")))
    hubs = settle(held.groupBy("key").agg(F.min("form").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("key", "_key"))
    return held, hubs


def candidates(held: DataFrame, hubs: DataFrame) -> DataFrame:
    """u, v: a star of candidate edges for each bucket."""
    return held.join(hubs, F.col("key") == F.col("_key")).where("form <> hub").select(F.col("form").alias("u"), F.col("hub").alias("v")).distinct()


def with_grams(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """`members` (form, doc, text_hash, ...) with grams, computed anew from the text of the document that stands for the form."""
    texts = docs.select(F.col("doc_id").alias("_d"), F.xxhash64(text_of()).alias("_h"), text_of().alias("_text"))
    joined = texts.join(members, F.col("_d").eqNullSafe(F.col("doc")) & (F.col("_h") == F.col("text_hash")))
    # Rows that repeat the id and the text are one.
    joined = joined.groupBy("form").agg(*[F.first(c).alias(c) for c in (*[c for c in members.columns if c != "form"], "_text")]).select(*members.columns, "_text")
    last = len(joined.columns) - 1

    def run(batches):
        known = held("jaccard", dict)
        for batch in batches:
            grams = [gram_set(t, n, known).view(np.int64) for t in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(grams, pa.list_(pa.int64()))], [*batch.schema.names[:last], "grams"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    return joined.mapInArrow(run, f"{kinds}, grams array<bigint>")


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each pair of n-gram sets has a Jaccard similarity of the threshold or more."""
    values, where = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = np.array([len(g) for g in (*left, *right)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    on_left = row < len(left)
    shared = (np.bincount(where[on_left], minlength=len(values)) > 0) & (np.bincount(where[~on_left], minlength=len(values)) > 0)
    number = np.cumsum(shared) - 1
    keep = shared[where]
    row, column = row[keep], number[where[keep]]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 2048):  # columns of shared n-grams, a bounded number at a time
        lo, hi = np.searchsorted(column, (at, at + 2048))
        r, c = row[lo:hi], column[lo:hi] - at
        a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        own = r < len(left)
        a[r[own], c[own]] = 1
        b[r[~own] - len(left), c[~own]] = 1
        common += a @ b.T
    total = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common >= threshold * total - 1e-6 * total


def roots(links: np.ndarray) -> np.ndarray:
    """The least index of each row's group, by a search over the symmetric matrix."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            reached, front = np.zeros(len(links), bool), np.zeros(len(links), bool)
            front[i] = reached[i] = True
            while front.any():
                front = links[front].any(axis=0) & ~reached
                reached |= front
            root[reached] = i
    return root


def first_band(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band in which each pair of band lists agrees (0 if in none)."""
    out = np.zeros((len(left), len(right)), np.int16)
    for k in reversed(range(left.shape[1])):
        out[left[:, k][:, None] == right[:, k][None, :]] = k
    return out


def verify_tile(threshold: float):
    """For one task: the units, or the two blocks of one unit, that it holds. In a bucket only pairs count that share no bucket of a band before."""

    def run(part: pa.Table) -> pa.Table:
        forms, counts = part["form"].to_pylist(), np.array(part["n"].to_pylist())
        grams = [np.asarray(g.values) for g in part["grams"].combine_chunks()] if part.num_rows else []
        side, band, bands = np.array(part["side"].to_pylist()), part["band"].to_pylist(), part["bands"].to_pylist()
        out: tuple[list, list, list] = [], [], []
        groups: dict[bytes, list[int]] = {}
        for i, u in enumerate(part["unit"].to_pylist()):
            groups.setdefault(u, []).append(i)
        for own in groups.values():
            rows = sorted(own, key=lambda i: (side[i], forms[i]))
            one = [i for i in rows if side[i] == 0]
            two = [i for i in rows if side[i] == 1] or one
            found = linked([grams[i] for i in one], [grams[i] for i in two], threshold)
            if band[rows[0]] is not None:
                found &= first_band(*(np.array([bands[i] for i in x]) for x in (one, two))) == band[rows[0]]
            if two is one:
                square = found
                np.fill_diagonal(square, False)
            else:
                square = np.zeros((len(rows), len(rows)), bool)
                square[: len(one), len(one) :] = found
                square |= square.T
            n_links, root = square @ counts[rows], roots(square)
            for k in np.flatnonzero(n_links):
                out[0].append(forms[rows[k]])
                out[1].append(int(n_links[k]))
                out[2].append(forms[rows[root[k]]])
        return pa.table({"form": pa.array(out[0], pa.binary()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.binary())})

    return run


def units(forms: DataFrame, comps: DataFrame, held: DataFrame, hubs: DataFrame, block: int) -> DataFrame:
    """form, places (array of unit, blocks, own block, band): where each candidate form's pairs are verified.

    A component is one unit, in blocks. One of more than `block` forms whose buckets hold fewer pairs than it does itself (a chain
    of false candidates) is verified bucket by bucket instead.
    """
    named = settle(comps.unionByName(comps.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("_form"), F.col("v").alias("comp")))
    members = settle(named.join(forms.select("form", "g"), F.col("_form") == F.col("form")).select("form", "g", "comp"))
    cost = hubs.join(named, F.col("hub") == F.col("_form")).groupBy("comp").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("pairs")).withColumnRenamed("comp", "_of")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("forms"), F.sum("g").alias("grams")).withColumnRenamed("comp", "_comp")
    sizes = settle(sizes.join(cost, F.col("_comp") == F.col("_of"), "left").select("_comp", "forms", "grams", ((F.col("forms") > block) & (F.col("pairs") < F.col("forms").cast("double") * F.col("forms"))).alias("chained")))
    placed = members.join(sizes, F.col("comp") == F.col("_comp")).select("form", "g", "comp", "forms", "grams", F.coalesce("chained", F.lit(False)).alias("chained"))
    whole = placed.where(~F.col("chained")).select("form", F.col("comp").alias("unit"), "forms", "grams", F.lit(None).cast("int").alias("band"))
    shared = held.join(hubs.select("_key"), F.col("key") == F.col("_key")).select(F.col("form").alias("_form"), "key", "band")
    chained = settle(placed.where("chained").join(shared, F.col("form") == F.col("_form")).select("form", "g", "key", "band"))
    by_key = chained.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("forms"), F.sum("g").alias("grams"))
    parts = chained.join(by_key, F.col("key") == F.col("_key")).select("form", F.concat(F.lit("bucket "), F.col("key").cast("string")).cast("binary").alias("unit"), "forms", "grams", "band")
    each = whole.unionByName(parts).withColumn("size", F.greatest(F.col("forms") / block, F.col("grams") / GRAMS)).withColumn("blocks", F.ceil("size").cast("int"))
    place = F.struct("unit", "blocks", F.pmod(F.xxhash64("form"), F.col("blocks")).cast("int").alias("own"), "band", (F.col("size") / F.col("forms")).alias("share"))
    return settle(each.groupBy("form").agg(F.collect_list(place).alias("places")))  # at most one place for each band


def verified(docs: DataFrame, forms: DataFrame, placed: DataFrame, n: int, threshold: float) -> DataFrame:
    """form, links (documents of other forms at the threshold or above), root: from every tile."""
    small = F.filter("places", lambda p: p["blocks"] == 1)
    n_bins = max(1, int(placed.agg(F.coalesce(F.sum(F.aggregate(small, F.lit(0.0), lambda a, p: a + p["share"])), F.lit(0.0))).first()[0]))
    by_band = F.exists("places", lambda p: p["band"].isNotNull())
    members = placed.withColumnRenamed("form", "_form").join(forms, F.col("_form") == F.col("form"))
    members = members.select("form", "n", F.col("first.id").alias("doc"), F.col("first.text_hash").alias("text_hash"), "places", F.when(by_band, F.col("bands")).alias("bands"))
    full = with_grams(docs, members, n)
    # Tile (i, j), i <= j: block i is side 0 and block j side 1; in tile (i, i) there is one side.
    tiles = F.transform(F.sequence(F.lit(0), F.col("p.blocks") - 1), lambda o: F.struct(F.least("p.own", o).alias("i"), F.greatest("p.own", o).alias("j"), (F.col("p.own") > o).cast("int").alias("side")))
    dealt = full.withColumn("p", F.explode("places")).withColumn("t", F.explode(tiles)).select("form", "n", "grams", "bands", F.col("p.unit").alias("unit"), F.col("p.band").alias("band"), F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.side").alias("side"), F.when(F.col("p.blocks") == 1, F.pmod(F.xxhash64("p.unit"), F.lit(n_bins))).otherwise(F.xxhash64("p.unit")).alias("bin"), (F.col("p.blocks") > 1).alias("large"))
    return dealt.groupBy("large", "bin", "i", "j").applyInArrow(verify_tile(threshold), "form binary, links long, root binary")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """doc_id, text_hash, form, n_grams, class_id (least doc_id of the group), n_links (other documents at the threshold or above), stands (whether id and text are those that stand for the group)."""
    bands, rows = bands_for(threshold, recall)
    sketched = settle(sketches(docs, n, bands, rows, seed))
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_hash")
    forms = settle(sketched.where("form is not null").groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min(who).alias("first"), F.max("n_grams").alias("g"), F.first("bands").alias("bands")))
    held, hubs = buckets(forms)
    comps = components(candidates(held, hubs))
    found = settle(verified(docs, forms, units(forms, comps, held, hubs, block), n, threshold))
    groups = components(found.select(F.col("form").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("form").agg(F.sum("links").alias("links")).withColumnRenamed("form", "_l")
    named = forms.select("form", "n", "first").join(groups.select(F.col("u").alias("_u"), F.col("v").alias("root")), F.col("form") == F.col("_u"), "left").join(links, F.col("form") == F.col("_l"), "left")
    named = settle(named.select("form", "n", "first", F.coalesce("root", "form").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    least = settle(named.groupBy("root").agg(F.min("first").alias("_least"))).withColumnRenamed("root", "_root")
    classes = settle(named.join(least, F.col("root") == F.col("_root")).select(F.col("form").alias("_form"), "_least", (F.col("links") + F.col("n") - 1).alias("_links")))
    alone = F.col("form").isNull()
    return sketched.join(classes, F.col("form") == F.col("_form"), "left").select(
        "doc_id", "text_hash", "form", "n_grams", F.when(alone, F.col("doc_id")).otherwise(F.col("_least.id")).alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("_least.id")) & (F.col("text_hash") == F.col("_least.text_hash")))).alias("stands"),
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of `docs` that stand for their group: the one of the least doc_id, then of the least text hash; of rows that repeat both, one.

    A row with a null id stands only for a group of such rows. Rows without n-grams all stay.
    """
    found = near_duplicates(docs, n, threshold, recall).where("stands")
    stay = settle(found.groupBy(F.col("doc_id").alias("_stay"), F.col("text_hash").alias("_hash")).agg((F.count("form") > 1).alias("_again")))
    at = lambda df: docs["doc_id"].eqNullSafe(df["_stay"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == df["_hash"])
    again = stay.where("_again")
    if not again.limit(1).count():
        return docs.join(stay, at(stay), "left_semi")
    once = stay.where("not _again")
    rows = docs.join(again, at(again), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_hash"))
    one = rows.groupBy("_id", "_hash").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row.*")
    return docs.join(once, at(once), "left_semi").unionByName(one)
