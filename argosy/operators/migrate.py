"""Migration of older record forms, as rewrites of DataFrames chained by version."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions import text as T
from argosy.operators import ids

Files = DataFrame  # (path, text)


def version(text: str) -> tuple[int, int]:
    """Major and minor; the patch doesn't count."""
    major, minor, *_ = [*map(int, text.split(".")), 0]
    return major, minor


def chain(files: Files, at: str, to: str, steps: dict[tuple[int, int], tuple[tuple[int, int], Callable[[Files], Files]]]) -> Files:
    """Applies converters from one version on until `to`; a newer or unknown version is refused."""
    now, goal = version(at), version(to)
    if now > goal:
        raise ValueError(f"format {at} is newer than {to}")
    while now != goal:
        if now not in steps:
            raise ValueError(f"no converter from {now}")
        now, convert = steps[now]
        files = convert(files)
    return files


def first_entries(entries: DataFrame) -> DataFrame:
    """The first of repeated ids (path, line, id, ...)."""
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("path", "line"))).where("_n = 1").drop("_n")


def minted(old: str, prefix: str, taken: set[str]) -> str:
    """A base-36 id from the hash of the old one, with a counter after collisions."""
    for n in range(1 << 16):
        x, body = int.from_bytes(hashlib.sha256(f"{old}:{n}".encode()).digest()[:8], "big"), ""
        for _ in range(6):
            x, d = divmod(x, 36)
            body += "0123456789abcdefghijklmnopqrstuvwxyz"[d]
        if f"{prefix}-{body}" not in taken:
            return f"{prefix}-{body}"
    raise ValueError("no free id")


def rename_ends(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges with both ends through a map (old, new)."""
    to = renames.select("old", "new")
    a = edges.join(to.withColumnsRenamed({"old": "_s", "new": "_sn"}), F.col("source") == F.col("_s"), "left").join(to.withColumnsRenamed({"old": "_t", "new": "_tn"}), F.col("target") == F.col("_t"), "left")
    return a.withColumn("source", F.coalesce("_sn", "source")).withColumn("target", F.coalesce("_tn", "target")).select(*edges.columns)


def with_unjudged_hash(records: DataFrame) -> DataFrame:
    """The last form's hash column, all zero: never judged."""
    return records.withColumn("judged_hash", F.lit("0" * 64))


def rename_register(files: Files, renames: dict[str, str]) -> Files:
    """Id prefixes of older registers, in every text."""
    out = F.col("text")
    for old, new in sorted(renames.items()):
        out = F.regexp_replace(out, rf"\b{old}-(?=[a-z0-9])", f"{new}-")
    return files.withColumn("text", out)


#: The fields of older registers' entries.
REGISTER_FIELDS = ("rigor", "status", "rationale", "rests-on", "lifted-by", "refuted-by", "references", "no-edge", "label")
REGISTER_STRUCTURE = r"^(?:---|### (?:Rigor|Strength)|Leaves:.*)?$"


def register_lines(docs: Files, prefix: str = T.PREFIX) -> DataFrame:
    """path, line (from 1), entry, field, value of every line inside the entries of register pages: a field, or (field null) a stray line that a conversion drops with a warning.

    An entry is a "## " section that holds a marker; indented lines and those after a rationale up to a blank line belong to the field before.
    """
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("_s", F.trim("raw"))
    order = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    heads = lines.withColumn("_n", F.sum(F.col("raw").startswith("## ").cast("int")).over(order))
    section = Window.partitionBy("path", "_n")
    found = F.nullif(F.regexp_extract("_s", rf"^<!--\s*{re.escape(prefix)}:\s*((?:clm|exp|ana|wrk|axm)-[a-z0-9]{{6}})", 1), F.lit(""))
    key = F.nullif(F.regexp_extract("_s", f"^- ({'|'.join(REGISTER_FIELDS)}):", 1), F.lit(""))
    marked = heads.withColumn("_id", found).withColumn("_k", key).withColumn("entry", F.min("_id").over(section)).where((F.col("_n") > 0) & F.col("entry").isNotNull())
    # A rationale runs on until a blank line or another field.
    stop = F.when(F.col("_k").isNotNull(), F.col("_k")).when(F.col("_s").rlike(REGISTER_STRUCTURE) | F.col("_id").isNotNull(), F.lit(""))
    runs = marked.withColumn("_run", F.last(stop, ignorenulls=True).over(section.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    stray = F.col("_k").isNull() & F.col("_id").isNull() & ~F.col("raw").startswith("## ") & ~F.col("_s").rlike(REGISTER_STRUCTURE) & ~F.col("raw").rlike(r"^[ \t]") & (F.col("_run") != "rationale")
    kept = runs.where(F.col("_k").isNotNull() | F.coalesce(stray, F.lit(False)))
    return kept.select("path", (F.col("at") + 1).alias("line"), "entry", F.col("_k").alias("field"), F.trim(F.when(F.col("_k").isNull(), F.col("_s")).otherwise(F.regexp_replace("_s", r"^- [a-z-]+:", ""))).alias("value"))


def split_arguments(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (id, title) and, for those with an argument, the analysis that lifts them (id, title, claim, text): older entries (path, line, id, title, argument) held both; of repeated ids the first entry counts."""
    first = first_entries(entries)
    arguments = first.where(F.trim(F.coalesce("argument", F.lit(""))) != "")
    lifting = arguments.select("title", F.col("id").alias("claim"), F.col("argument").alias("text"))
    return first.select("id", "title"), ids.minted(lifting, "ana", F.col("claim")).select("id", "title", "claim", "text")


def one_marker_each(docs: Files, lifts: DataFrame, old: str, new: str = T.PREFIX) -> Files:
    """The documents with every older marker as one marker for each id it names, right behind the text before it.

    The marker of an analysis alone on its line joins the line above if that ends in the marker of a claim it lifts (lifts: analysis, claim).
    """
    named = T.udf(lambda x: [i for m in T.marker(old).finditer(T.closing(x)[0]) for i in T.ID_TOKEN.findall(m[1])], "array<string>")
    ids = docs.select(F.col("path").alias("_p"), F.explode(named("text")).alias("analysis"))
    own = ids.join(lifts.select("analysis", "claim"), "analysis").groupBy("_p").agg(F.collect_set(F.concat_ws(" ", "analysis", "claim")).alias("_l"))

    @F.pandas_udf("string")
    def convert(text: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([moved_markers(t, set() if h is None else set(h), old, new) for t, h in zip(text, held, strict=True)], dtype=object)

    return docs.join(own, F.col("path") == F.col("_p"), "left").select(*[convert("text", "_l").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def moved_markers(text: str, lifts: set[str], old: str, new: str) -> str:
    mark = T.marker(old)
    rows: list[str] = []
    for line in text.split("\n"):
        alone = mark.fullmatch(line.strip())
        above = [i for m in mark.finditer(rows[-1]) for i in T.ID_TOKEN.findall(m[1])] if rows and rows[-1].rstrip().endswith("-->") else []
        own = T.ID_TOKEN.findall(alone[1]) if alone else []
        if above and len(own) == 1 and f"{own[0]} {above[-1]}" in lifts:
            rows[-1] = rows[-1].rstrip() + line.strip()
        else:
            rows.append(line)
    each = lambda m: "".join(f"<!-- {new}: {i} -->" for i in T.ID_TOKEN.findall(m["ids"])) if T.ID_TOKEN.search(m["ids"]) else m[0]
    head, rest = T.closing("\n".join(rows))
    return re.sub(rf"(?s)(?:(?<=\S)[ \t]+)?<!--\s*{re.escape(old)}:(?P<ids>.*?)-->", each, head) + rest


def statement_citations(docs: Files, sections: DataFrame) -> tuple[Files, DataFrame]:
    """Documents whose links into a section (id, path, anchor) that states one node alone take its id as title; and warnings (path, line, destination, n) for sections that state several."""
    links = T.links_of(docs).where("link.title = ''").withColumn("_to", T.udf(lambda x: "#".join(T.resolved(*x.split("\0", 1))), "string")(F.concat_ws("\0", "path", "link.destination")))
    states = sections.where("anchor <> ''").groupBy(F.concat_ws("#", "path", "anchor").alias("_at")).agg(F.min("id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    found = links.join(states, F.col("_to") == F.col("_at")).select("path", "line", F.col("link.destination").alias("destination"), "_id", "_n")
    held = found.where("_n = 1").groupBy(F.col("path").alias("_p")).agg(F.map_from_entries(F.collect_set(F.struct("destination", "_id"))).alias("_m"))

    @F.pandas_udf("string")
    def cited(text: pd.Series, to: pd.Series) -> pd.Series:
        def put(m: re.Match, names: dict) -> str:
            return m[0] if m[3] or m[2] not in names else f'[{m[1]}]({m[2]} "{names[m[2]]}")'

        return pd.Series([T.LINK.sub(lambda m, n=dict(n): put(m, n), t) for t, n in zip(text, to, strict=True)], dtype=object)

    return docs.join(held, F.col("path") == F.col("_p")).select("path", cited("text", "_m").alias("text")), found.where("_n > 1").select("path", "line", "destination", F.col("_n").alias("n"))
