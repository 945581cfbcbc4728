"""Edit scripts: a table of insertions and removals by offset, applied to each document in one pass; and the script that leaves every node one marker.

A script's rows are (path, rank, start, stop, text): the code points from start to stop are replaced (an insertion where both are equal). Edits are taken
in the order of rank, start, stop, text. One that overlaps a removal taken before, or would remove around an insertion taken before, is refused and
reported. Insertions at one place never conflict; they stand in order, before what is replaced there.

Which markers stay is decided by joins and aggregates over all documents; where a missing one goes is read off its own document. A document's edits meet
with its text, as many as it has.

Defined results: null texts are empty; edits beyond a text's ends, or that stop before they start, are refused; edits of unknown documents
are left out; rows that repeat are one edit; empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.functions import text as T

SCRIPT = "array<struct<rank: int, start: int, stop: int, text: string>>"
# An equation's title, the line that holds its label, and a labelled block's first line.
EQUATION = re.compile("(?s)^Equation \\(`([^`]+)`\\) — .+$")
LOCATOR = "\\label{{{}}}"
BLOCK_LABEL = re.compile(r'^>\s*(?:<span id="[^"]*">)?\*\*[A-Za-z]+(?: [A-Za-z]+)*\*\*(?:</span>)?\s*$')


def apply_script(text: str, script: list[tuple[int, int, int, str]]) -> tuple[str, list[tuple[int, int, int, str]]]:
    """The text after a script of (rank, start, stop, text), and the edits refused."""
    cuts: list[tuple[int, int]] = []  # removals taken, disjoint and sorted
    places: list[int] = []  # insertions taken
    taken, refused = [], []
    for edit in sorted(set(script)):
        _, start, stop, _ = edit
        i = bisect_right(cuts, (start, len(text) + 1)) - 1  # the last removal that starts at or before this edit
        within = i >= 0 and cuts[i][1] > start and (stop > start or cuts[i][0] < start)
        ahead = stop > start and i + 1 < len(cuts) and cuts[i + 1][0] < stop
        around = stop > start and bisect_left(places, stop) > bisect_right(places, start)
        if not 0 <= start <= stop <= len(text) or within or ahead or around:
            refused.append(edit)
            continue
        taken.append(edit)
        if stop > start:
            insort(cuts, (start, stop))
        else:
            insort(places, start)
    out, at = [], 0
    for _, start, stop, new in sorted(taken, key=lambda e: (e[1], e[2] > e[1], e[0], e[3])):
        out += [text[at:start], new]
        at = max(at, stop)
    return "".join([*out, text[at:]]), refused


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs' columns with the text after its edits, and refused (array of edits) for (path, text, ...) and edits (path, rank, start, stop, text)."""

    @F.pandas_udf(f"struct<text: string, refused: {SCRIPT}>")
    def run(texts: pd.Series, scripts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, script in zip(texts, scripts, strict=True):
            new, refused = apply_script(text or "", [] if script is None else [(e["rank"], e["start"], e["stop"], e["text"] or "") for e in script])
            rows.append((new, [dict(zip(("rank", "start", "stop", "text"), e, strict=True)) for e in refused]))
        return pd.DataFrame(rows, columns=["text", "refused"])

    scripts = edits.groupBy(F.col("path").alias("_path")).agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "text")).alias("_script"))
    done = docs.join(scripts, F.col("path") == F.col("_path"), "left").withColumn("_done", run("text", "_script"))
    return done.select(*[F.col("_done.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col("_done.refused").alias("refused"))


class Placement(NamedTuple):
    """Markers to take away (path, nth, id, why), markers to put in (path, kind, id, line), and listings that become mentions (path, id, host)."""

    drops: DataFrame
    puts: DataFrame
    mentions: DataFrame


def numbered_markers(docs: DataFrame, prefix: str = T.PREFIX) -> DataFrame:
    """path, nth (marker of the document, from 0), id of every statement marker's ids."""

    def find(text: str):
        return [{"nth": n, "id": i} for n, m in enumerate(T.marker(prefix).finditer(T.closing(text)[0])) for i in dict.fromkeys(T.ID_TOKEN.findall(m[1]))]

    return docs.select("path", F.explode(T.udf(find, "array<struct<nth: int, id: string>>")("text")).alias("m")).select("path", "m.*")


def decide(markers: DataFrame, claims: DataFrame, listing: DataFrame, hosted: DataFrame) -> Placement:
    """Which markers (path, nth, id) stay, so that each node has one.

    A claim (id) keeps its first marker in the first document that lists it (path, id) and marks it; one that is listed and marked by none of these gets a marker in the
    first that lists it; one that no document lists keeps its first marker. An analysis or experiment (hosted: id, path, line) keeps its first marker, or gets one
    in its document. Markers of ids that are neither go.
    """
    own = claims.select("id").distinct()
    listed = listing.select("path", "id").distinct().join(own, "id", "left_semi")
    first = listed.groupBy("id").agg(F.min("path").alias("listing"))
    here = markers.join(listed.withColumn("here", F.lit(True)), ["path", "id"], "left").withColumn("away", F.col("here").isNull())
    best = here.groupBy("id").agg(F.min(F.struct("away", "path", "nth")).alias("b"))
    of_claims = best.join(own, "id", "left_semi").join(first, "id", "left").where(~F.col("b.away") | F.col("listing").isNull())
    nodes = hosted.groupBy("id").agg(F.min(F.struct("path", "line")).alias("d")).select("id", F.col("d.path").alias("path"), F.col("d.line").alias("line"))
    of_hosted = here.join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("path", "nth")).alias("b"))
    kept = of_claims.select("id", "b.path", "b.nth").unionByName(of_hosted.select("id", "b.path", "b.nth")).distinct()
    known = own.unionByName(nodes.select("id")).distinct().withColumn("known", F.lit(True))
    gone = markers.join(kept, ["path", "nth", "id"], "left_anti").join(known, "id", "left")
    drops = gone.select("path", "nth", "id", F.when(F.col("known").isNull(), "names no node").otherwise("its marker is elsewhere").alias("why"))
    homes = kept.groupBy("id").agg(F.min("path").alias("host"))
    missing = first.join(homes, "id", "left_anti")
    puts = missing.select(F.col("listing").alias("path"), F.lit("claim").alias("kind"), "id", F.lit(0).alias("line")).unionByName(nodes.join(homes, "id", "left_anti").select("path", F.lit("hosted").alias("kind"), "id", F.col("line").cast("int").alias("line")))
    settled = homes.unionByName(missing.select("id", F.col("listing").alias("host")))
    return Placement(drops, puts, listed.join(settled, "id").where("path <> host").select("path", "id", "host"))


def marker_script(text: str, drops: list[tuple[int, str]], claims: list[tuple[str, str]], hosted: list[str], statements: int, prefix: str = T.PREFIX) -> tuple[list[tuple[int, int, int, str]], list[tuple[str, str]]]:
    """The edits that take away drops (nth, id) and put in markers of claims (id, title) and hosted ids; and (id, warning) for markers on or without a heading.

    An equation's marker stands on the line of its fence that holds its label; the only listed statement of a document with one labelled block on the block's first line;
    any other on the first heading. Hosted ids stand on lines of their own after the first heading. A marker that keeps some ids is written anew; one that keeps
    none goes with the space before it, and with its line if that is left blank.
    """
    lines, ends = text.splitlines(), [0]
    for full in text.splitlines(keepends=True):
        ends.append(ends[-1] + len(full))
    own = lambda id: f"<!-- {prefix}: {id} -->"
    gone: dict[int, set[str]] = {}
    for nth, id in drops:
        gone.setdefault(nth, set()).add(id)
    script, spans = [], []
    for nth, m in enumerate(T.marker(prefix).finditer(T.closing(text)[0])):
        ids = dict.fromkeys(T.ID_TOKEN.findall(m[1]))
        if kept := [i for i in ids if i not in gone.get(nth, ())]:
            if len(kept) < len(ids):
                script.append((1, *m.span(), " ".join(map(own, kept))))
        elif nth in gone:
            spans.append(m.span())
    groups: list[list] = []  # line ranges with the markers that go from them
    for a, b in spans:
        low, high = bisect_right(ends, a) - 1, bisect_left(ends, b)
        if groups and groups[-1][1] > low:
            groups[-1] = [groups[-1][0], max(groups[-1][1], high), [*groups[-1][2], (a, b)]]
        else:
            groups.append([low, high, [(a, b)]])
    for low, high, held in groups:
        edges = [ends[low], *[x for span in held for x in span], ends[high]]
        if not any(text[edges[i] : edges[i + 1]].strip() for i in range(0, len(edges), 2)):
            script.append((1, ends[low], ends[high], ""))
        else:
            script += [(1, a - (a > ends[low] and text[a - 1] == " "), b, "") for a, b in held]
    if not claims and not hosted:
        return script, []
    plain = T.strip_code(text).splitlines()
    heading = next((i for i, x in enumerate(plain) if T.HEADING.match(x)), None)
    labels = [i for i, x in enumerate(plain) if BLOCK_LABEL.match(x)]
    fences, warnings = [(a, b) for a, b, info in T.fences(lines) if info == "math"], []
    after = lambda i: ends[i] + len(lines[i].rstrip(" \t"))
    for rank, (id, title) in enumerate(claims):
        at, equation = None, EQUATION.match(title or "")
        if equation:
            at = next((i for a, b in fences for i in range(a + 1, b - 1) if LOCATOR.format(equation[1]) in lines[i]), None)
        elif statements == 1 and len(labels) == 1:
            at = next((i for i in range(labels[0] + 1, len(plain)) if not (q := T.QUOTE.match(plain[i])) or plain[i][q.end() :].strip()), None)
            at = at if at is not None and T.QUOTE.match(plain[at]) else None
        if at is None:
            warnings.append((id, "on the first heading" if heading is not None else "no heading to carry it"))
            at = heading
        if at is not None and own(id) not in lines[at]:
            script.append((2 + rank, after(at), after(at), f" {own(id)}"))
    if heading is None:
        warnings += [(id, "no heading to place it after") for id in hosted]
    else:
        end = ends[heading] + len(lines[heading])
        script += [(2 + len(claims) + i, end, end, f"\n{own(id)}") for i, id in enumerate(hosted)]
    return script, warnings


def placed_markers(docs: DataFrame, claims: DataFrame, listing: DataFrame, hosted: DataFrame, prefix: str = T.PREFIX) -> tuple[DataFrame, DataFrame, Placement]:
    """The script (path, rank, start, stop, text) that leaves each node one marker, warnings (path, id, warning), and the decisions, for docs (path, text), claims (id, title), listing (path, id), hosted (id, path, line)."""
    found = decide(numbered_markers(docs, prefix), claims, listing, hosted)
    titles = claims.groupBy("id").agg(F.min("title").alias("title"))
    puts = found.puts.join(titles, "id", "left")
    drops = found.drops.groupBy("path").agg(F.collect_list(F.struct("nth", "id")).alias("drops"))
    asked = puts.groupBy("path").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "claim", F.struct("id", "title")))).alias("claims"), F.sort_array(F.collect_list(F.when(F.col("kind") == "hosted", F.struct("line", "id")))).alias("hosted")
    )
    equation = F.coalesce(F.col("title").rlike("(?s)^Equation \\(`[^`]+`\\) — .+$"), F.lit(False))
    counts = listing.select("path", "id").distinct().join(titles, "id").groupBy("path").agg(F.count_if(~equation).alias("statements"))

    @F.pandas_udf(f"struct<script: {SCRIPT}, warnings: array<struct<id: string, warning: string>>>")
    def run(texts: pd.Series, drops: pd.Series, claims: pd.Series, hosted: pd.Series, statements: pd.Series) -> pd.DataFrame:
        rows, listed = [], lambda x: [] if x is None else list(x)
        for text, d, c, h, n in zip(texts, drops, claims, hosted, statements, strict=True):
            script, warnings = marker_script(text or "", [(x["nth"], x["id"]) for x in listed(d)], [(x["id"], x["title"]) for x in listed(c)], [x["id"] for x in listed(h)], int(n), prefix)
            rows.append(([dict(zip(("rank", "start", "stop", "text"), e, strict=True)) for e in script], [{"id": i, "warning": w} for i, w in warnings]))
        return pd.DataFrame(rows, columns=["script", "warnings"])

    touched = docs.select("path", "text").join(drops.join(asked, "path", "full"), "path").join(counts, "path", "left")
    made = touched.select("path", run("text", "drops", "claims", "hosted", F.coalesce("statements", F.lit(0))).alias("m"))
    return made.select("path", F.explode("m.script").alias("e")).select("path", "e.*"), made.select("path", F.explode("m.warnings").alias("w")).select("path", "w.*"), found
