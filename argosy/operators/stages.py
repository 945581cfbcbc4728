"""Stages from text to graph: what a volume holds, claims from paragraphs, equations, dependencies, analyses. Judgements are tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.operators import build, enclosing, graph, ids
from argosy.sources.records import EDGE_SCHEMA, NODE_SCHEMA

#: Names that a block's title opens with.
BLOCK_TITLE = re.compile(r"(?i)^(?:theorem|proposition|corollary|lemma|conjecture|definition|remark|example|claim)\b")


def seed(spark: SparkSession, title: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Empty nodes and edges, and the documents of a knowledge base that holds nothing yet."""
    docs = [("index.md", f"# {title}\n"), ("axioms.md", "# Axioms\n")]
    return spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), spark.createDataFrame(docs, "path string, text string")


def facts(docs: DataFrame) -> DataFrame:
    """path, kind (heading, fence, link, marker, mention), name, line of everything a document declares."""

    def find(text: str):
        lines = text.splitlines()
        out = [{"kind": "heading", "name": str(k), "line": n} for n, k, _ in T.headings(text)]
        out += [{"kind": "fence", "name": info, "line": a + 1} for a, _, info in T.fences(lines)]
        out += [{"kind": "link", "name": "citation" if x[2] else "plain", "line": i + 1} for i, line in enumerate(T.strip_code(text).splitlines()) for x in T.links(line)]
        out += [{"kind": "marker", "name": i[:3], "line": n + 1} for i, n, _ in T.markers(text)]
        return out + [{"kind": "mention", "name": k, "line": 0} for k, _, _ in M.mentions(text)]

    return docs.select("path", F.explode(T.udf(find, "array<struct<kind: string, name: string, line: int>>")("text")).alias("f")).select("path", "f.*")


def blocks(docs: DataFrame) -> DataFrame:
    """path, start, stop (lines from 1, half open), id of every section (h and its line) and fenced block (f and its line); they nest."""

    def find(text: str):
        out, stack, end = [], [], len(text.splitlines()) + 1
        for line, level, _ in [*T.headings(text), (end, 0, "")]:
            while stack and stack[-1][1] >= level:
                out.append({"start": stack[-1][0], "stop": line, "id": f"h{stack[-1][0]}"})
                stack.pop()
            stack.append((line, level))
        return out + [{"start": a + 1, "stop": b + 1, "id": f"f{a + 1}"} for a, b, _ in T.fences(text.splitlines())]

    return docs.select("path", F.explode(T.udf(find, "array<struct<start: int, stop: int, id: string>>")("text")).alias("b")).select("path", "b.*")


def hosted_facts(docs: DataFrame) -> DataFrame:
    """path, kind, name, line, host, depth, at: everything that stands on a line, with the innermost block around it and its order there."""
    return enclosing.innermost(facts(docs).where("line > 0"), blocks(docs))


def census(found: DataFrame) -> DataFrame:
    """kind, name, n, documents: the inventory counted."""
    return found.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("documents"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """path, at (from 0), paragraph (collapsed) of every paragraph outside fences and headings that may open a claim."""

    def find(text: str):
        lines = text.splitlines()
        for a, b, _ in T.fences(lines):
            lines[a:b] = [""] * (b - a)
        rows = [T.normal_space(x) for x in re.split(r"\n[ \t]*\n", "\n".join(lines))]
        return [{"at": i, "paragraph": x} for i, x in enumerate(rows) if x and not x.startswith("#") and len(T.words(x)) >= 4]

    return docs.select("path", F.explode(T.udf(find, "array<struct<at: int, paragraph: string>>")("text")).alias("p")).select("path", "p.*")


def discovered(found: DataFrame, verdicts: DataFrame, yes: str = "A", reserved: DataFrame | None = None) -> DataFrame:
    """id, title, host, at: a claim for every paragraph whose verdict (path, at, letter) is yes; a title that is taken in its document carries its place, and no id is one of `reserved` (id)."""
    held = found.join(verdicts.where(F.col("letter") == yes).select("path", "at"), ["path", "at"], "left_semi")
    short = held.withColumn("_t", T.udf(lambda x: M.title(x, 0, set()), "string")(F.element_at(T.udf(T.sentences, "array<string>")("paragraph"), 1)))
    nth = F.row_number().over(Window.partitionBy("path", "_t").orderBy("at"))
    title = F.when(nth == 1, F.col("_t")).otherwise(F.concat("_t", F.lit(" (¶"), F.col("at") + 1, F.lit(")")))
    named = short.select(title.alias("title"), F.col("path").alias("host"), "at")
    return ids.minted(named, "clm", F.concat_ws(":", "host", "at"), reserved).select("id", "title", "host", "at")


def unheld(references: DataFrame, fences: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """document, label, start, id: an equation for every label that a counting reference (document, label) names and no claim or proof holds (fences: document, label, start, held); of repeated labels the first."""
    open_ = fences.where(~F.col("held")).groupBy("document", "label").agg(F.min("start").alias("start"))
    named = open_.join(references.select("document", "label").distinct(), ["document", "label"], "left_semi")
    return ids.minted(named.select("document", "label", "start"), "clm", F.concat_ws(":", "document", "label"), reserved)


def contained(inner: DataFrame, outer: DataFrame, width: int = 256) -> DataFrame:
    """inner and outer columns of every span (path, start, stop) within another span's (path, start, stop), half open, of the same document."""
    points = inner.select(F.col("path"), F.col("start").alias("line"), F.struct(*inner.columns).alias("inner"))
    spans = outer.select("path", "start", "stop", F.struct(*outer.columns).alias("outer"))
    return build.inside(points, spans, width).where(F.col("inner.stop") <= F.col("outer.stop")).select("inner", "outer")


def visual_kind(title: str, text: str | None, id: str) -> str:
    """equation, block or prose: how a claim looks where its marker stands, else by its title."""
    at = None if text is None else next((n for i, n, _ in T.markers(text) if i == id), None)
    if at is None:
        return "equation" if title.startswith("Equation ") else "block" if BLOCK_TITLE.match(title) else "prose"
    lines = text.splitlines()
    if any(a <= at < b and info == "math" for a, b, info in T.fences(lines)):
        return "equation"
    if not T.QUOTE.match(lines[at]):
        return "prose"
    first = at
    while first > 0 and T.QUOTE.match(lines[first - 1]):
        first -= 1
    opening = next((x for x in (T.QUOTE.sub("", y).strip() for y in lines[first : at + 1]) if x), "")
    return "block" if opening.startswith("**") else "prose"


def visual_kinds(nodes: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """id, look of every claim by its host (id, path)."""
    held = first.select(F.col("id").alias("_i"), F.col("path").alias("_p"))
    joined = nodes.where("kind = 'claim'").select("id", "title").join(held, F.col("id") == F.col("_i"), "left").join(docs.select(F.col("path").alias("_d"), "text"), F.col("_p") == F.col("_d"), "left")

    @F.pandas_udf("string")
    def look(title, text, id):
        import pandas as pd

        return pd.Series([visual_kind(a or "", b, c) for a, b, c in zip(title, text, id, strict=True)], dtype=object)

    return joined.select("id", look("title", "text", "id").alias("look"))


def splits(docs: DataFrame) -> DataFrame:
    """id, document, line, title, rest: claims whose paragraph holds text beyond the sentence that states them; the rest is an analysis's, marked on that line."""

    def find(text: str):
        stated = M.statements(text)
        out = []
        for id, n, _ in T.markers(text):
            whole = T.sentences(T.normal_space(stated.get(id, "")))
            if len(whole) > 1:
                out.append({"id": id, "line": n + 1, "title": whole[0], "rest": " ".join(whole[1:])})
                stated.pop(id)
        return out

    got = docs.select("path", F.explode(T.udf(find, "array<struct<id: string, line: int, title: string, rest: string>>")("text")).alias("s"))
    return got.select("s.id", F.col("path").alias("document"), "s.line", "s.title", "s.rest")


def attributed(offers: DataFrame, answers: DataFrame, nodes: DataFrame, held: DataFrame) -> DataFrame:
    """relation, replaced_relation, source, target: edges of offered pairs (source, target, allowed) by their answers (source, target, relation), if allowed; those that close cycles with each other or with what is held are demoted."""
    said = answers.select(F.col("source").alias("_s"), F.col("target").alias("_t"), "relation")
    made = offers.join(said, (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t"))).where(F.array_contains("allowed", F.col("relation"))).select("relation", "source", "target").distinct()
    cuts = graph.cycle_cuts(made.unionByName(held.select("relation", "source", "target")), nodes).drop("rank").withColumn("_cut", F.lit(True))
    joined = made.join(cuts, ["relation", "source", "target"], "left")
    return joined.select(F.when(F.col("_cut"), "demoted").otherwise(F.col("relation")).alias("relation"), F.when(F.col("_cut"), F.col("relation")).alias("replaced_relation"), "source", "target")


def tally(*counts: tuple[str, DataFrame, str]) -> DataFrame:
    """what, value, n of each named table by one of its columns: a stage's report."""
    return reduce(DataFrame.unionByName, [df.groupBy(F.col(by).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "value", "n") for what, df, by in counts])


def conforms(*gates: DataFrame) -> DataFrame:
    """gate (from 1), check, subject, detail of what each gate finds; a build stands if there is no row."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(i + 1).alias("gate"), "check", "subject", "detail") for i, df in enumerate(gates)])
