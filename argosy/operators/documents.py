"""The document stage: cutting documents at their headings, their words, partition checks, paths, alignment, cross-references."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.operators.build import multiset_diff
from argosy.operators.render import page_anchors
from argosy.operators.verify import fault

SECTION = "array<struct<n: int, level: int, title: string, line: int, parent: int, segment: string>>"
MARKS = re.compile(r"(?m)^[ \t]*(?:#{1,6}[ \t]+|(?:>[ \t]?)+|[-*+][ \t]+|\d+[.)][ \t]+)")


def cut(text: str) -> list[dict]:
    """A text's sections in order: what stands before the first heading (0), then each heading with its text up to the next; the parent is the section before of a lower level."""
    lines, heads, out = text.splitlines(), T.headings(text), []
    starts = [(1, 0, ""), *heads] if not heads or heads[0][0] > 1 else heads
    open_: list[tuple[int, int]] = []  # level and number of the sections around
    for i, (line, level, title) in enumerate(starts):
        stop = starts[i + 1][0] - 1 if i + 1 < len(starts) else len(lines)
        while open_ and open_[-1][0] >= level:
            open_.pop()
        out.append({"n": i, "level": level, "title": title, "line": line, "parent": open_[-1][1] if open_ else None, "segment": "\n".join(lines[line - 1 : stop])})
        open_.append((level, i))
    return out


def sections(docs: DataFrame) -> DataFrame:
    """path, n, level, title, line, parent, segment of every section of (path, text)."""
    return docs.select("path", F.explode(T.udf(cut, SECTION)("text")).alias("s")).select("path", "s.*")


def tokens(text: str) -> list[str]:
    """Words with markup undone; fenced blocks are taken verbatim, without their fences."""
    lines, out, at = text.splitlines(), [], 0
    for a, b, _ in [*T.fences(lines), (len(lines), len(lines), "")]:
        head, rest = T.closing("\n".join(lines[at:a]))
        prose = re.sub(r"(?s)<!--.*?-->", " ", head) + rest
        prose = T.LINK.sub(lambda m: m[1], MARKS.sub("", prose))
        out += re.sub(r"[`*]", "", prose).split()
        out += " ".join(lines[a + 1 : b - 1]).split()
        at = b
    return out


def lost_words(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """path, word, lost, added: words that a document (path, text) has more or less often than its segments (path, segment) together."""
    words = lambda df, c: df.select("path", F.explode(T.udf(tokens, "array<string>")(c)).alias("word"))
    return multiset_diff(words(docs, "text"), words(parts, "segment"), ["path", "word"])


def missed_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """path, run of runs of words (path, run array) that don't stand in the document's words one after the other."""
    own = docs.select(F.col("path").alias("_p"), T.udf(tokens, "array<string>")("text").alias("_t"))
    # No word holds a white space, so a run is a substring between separators.
    between = lambda c: F.concat(F.lit("\n"), F.array_join(c, "\n"), F.lit("\n"))
    return runs.join(own, F.col("path") == F.col("_p")).where((F.size("run") > 0) & ~F.contains(between("_t"), between("run"))).select("path", "run")


def section_paths(cut_: DataFrame) -> DataFrame:
    """path, n, slug: every section's own name below its parent, made unique among its siblings in order."""
    named = cut_.where("level > 0").select(F.concat_ws("\n", "path", F.coalesce("parent", F.lit(-1))).alias("page"), F.struct("path", "n").alias("at"), F.col("title").alias("heading"))
    return page_anchors(named).select("at.path", "at.n", F.col("anchor").alias("slug"))


def own_prose(cut_: DataFrame) -> DataFrame:
    """path, n of the sections that have both children and text of their own: that text is lifted into a leaf of its own."""
    parents = cut_.where("parent is not null").select(F.col("path").alias("_p"), F.col("parent").alias("_n")).distinct()
    body = F.regexp_replace("segment", r"^[^\n]*\n?", "")
    return cut_.where((F.col("level") > 0) & (F.trim(body, F.lit(" \t\n")) != "")).join(parents, (F.col("path") == F.col("_p")) & (F.col("n") == F.col("_n")), "left_semi").select("path", "n")


def misaligned(expected: DataFrame, cut_: DataFrame) -> DataFrame:
    """Faults of an outline (path, n, title) against the sections found: a heading that one side lacks or words otherwise."""
    found = cut_.where("level > 0").select(F.col("path").alias("_p"), F.col("n").alias("_n"), F.col("title").alias("_t"))
    joined = expected.join(found, (F.col("path") == F.col("_p")) & (F.col("n") == F.col("_n")), "full_outer")
    what = F.when(F.col("_p").isNull(), "not rendered").when(F.col("path").isNull(), "not in the outline").when(F.col("title") != F.col("_t"), "other words")
    return fault(joined.where(what.isNotNull()), "heading alignment", F.concat_ws(" ", F.coalesce("path", "_p"), F.coalesce("n", "_n")), what)


def rewritten(docs: DataFrame, moved: DataFrame) -> DataFrame:
    """path, text of the documents some of whose destinations (path, old, new) change."""
    held = moved.groupBy(F.col("path").alias("_p")).agg(F.map_from_entries(F.collect_set(F.struct("old", "new"))).alias("_m"))

    @F.pandas_udf("string")
    def point(text, to):
        return text.combine(to, lambda t, m: M.repoint(t, dict(m)))

    return docs.join(held, F.col("path") == F.col("_p")).select("path", point("text", "_m").alias("text"))
