"""Renaming ids in prose by a map of any size, in one job.

Each document is cut into its id tokens with their places, tokens are joined with the map, and what is found goes back as an edit script. So the
map costs one join, whether it holds ten names or a table's; a token that most documents hold is one row of the map, and Spark splits its side of the join.

Defined results: a token counts as a whole only, between word boundaries; `bare` leaves out statement markers, links' destinations and titles and
definitions, `all` reads them too; neither reads code; a name that the map gives twice takes the least; names chained in the map are
not followed (every token is renamed once); null names count for nothing; null texts are empty; other columns stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.functions import text as T
from argosy.operators.edits import apply_edits

#: Ids of older records in prose; an axiom's and a work's label is read to its last letter or digit.
OLD_ID = r"(?:clm|exp|ana)-[a-z0-9]{6}|(?:axm|wrk)-[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"


def tokens(text: str, pattern: re.Pattern, bare: bool, prefix: str = T.PREFIX) -> list[tuple[int, int, str]]:
    """start, stop, token of every id in a text, outside code."""
    raw, plain, out, at = text.splitlines(keepends=True), T.strip_code(text).splitlines(), [], 0
    for full, line in zip(raw, plain, strict=False):
        shut = []
        if bare:
            links = [(e - len(line[s:e].rpartition("](")[2]), e) for _, _, _, s, e in T.links(line)]
            shut = [sorted(x) for x in ([m.span() for m in T.marker(prefix).finditer(T.closing(line)[0])], links, [m.span() for m in T.REFERENCE.finditer(line)])]
        for m in pattern.finditer(line):
            if not any((i := bisect_right(held, m.start(), key=lambda x: x[0]) - 1) >= 0 and m.end() <= held[i][1] for held in shut):
                out.append((at + m.start(), at + m.end(), m[0]))
        at += len(full)
    return out


def tokens_of(docs: DataFrame, pattern: str = OLD_ID, scope: str = "bare", prefix: str = T.PREFIX) -> DataFrame:
    """path, start, stop, token of every id in (path, text)."""
    if scope not in ("bare", "all"):
        raise ValueError(f"no scope {scope}")

    def find(text: str):
        return [{"start": a, "stop": b, "token": x} for a, b, x in tokens(text, re.compile(rf"\b(?:{pattern})\b"), scope == "bare", prefix)]

    return docs.select("path", F.explode(T.udf(find, "array<struct<start: int, stop: int, token: string>>")("text")).alias("t")).select("path", "t.*")


def _names(names: DataFrame) -> DataFrame:
    return names.where("old is not null and new is not null").groupBy("old").agg(F.min("new").alias("new"))


def renamed(docs: DataFrame, names: DataFrame, pattern: str = OLD_ID, scope: str = "bare", prefix: str = T.PREFIX) -> DataFrame:
    """docs (path, text, ...) with the ids in their texts renamed by names (old, new); one path is one document."""
    found = tokens_of(docs, pattern, scope, prefix).join(_names(names), F.col("token") == F.col("old")).where("old <> new")
    return apply_edits(docs, found.select("path", F.lit(0).alias("rank"), "start", "stop", F.col("new").alias("text"))).drop("refused")


def renamed_ids(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """`df` with the ids of some columns renamed, as of records and their edges."""
    for c in columns:
        held = _names(names).select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        order = df.columns
        df = df.join(held, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).select(*[F.col(f"`{x}`") for x in order])
    return df
