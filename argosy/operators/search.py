"""Search of many excerpts in all documents at once.

Excerpts are dealt to blocks of a bounded number of characters; a block is one automaton (Aho-Corasick), sent to the tasks, and every
document runs through it once, in time linear in the document and its hits, however many excerpts there are. Nothing is compared pair by pair. A second
automaton over folded words serves the excerpts that a document doesn't hold as they stand.

Defined results: white space is collapsed on both sides and quote marks at a line's start are left out; a hit counts on the line it begins on, every
overlapping hit for itself; excerpts that repeat under one id count once, null and blank ones find nothing; null documents are empty;
an excerpt longer than a block is a block of its own; empty tables give an empty result.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.functions import text as T
from argosy.operators.prefix import before
from argosy.plans.star import settle


def _automaton(patterns: dict[str, list[int]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, owners in patterns.items():
        found.add_word(pattern, (len(pattern), owners))
    found.make_automaton()
    return found


def _hits(automaton, text: str) -> Iterator[tuple[int, int]]:
    """(owner, start) of every hit."""
    if len(automaton):
        for end, (length, owners) in automaton.iter(text):
            for owner in owners:
                yield owner, end - length + 1


class Searcher:
    """A block of excerpts, ready to be looked for."""

    def __init__(self, excerpts: list[str], loose: bool):
        plain: dict[str, list[int]] = {}
        folded: dict[str, list[int]] = {}
        for i, excerpt in enumerate(excerpts):
            wanted = T.normal_space(excerpt)
            if wanted:
                plain.setdefault(wanted, []).append(i)
                if loose and (words := T.canonical(wanted)):
                    folded.setdefault(words, []).append(i)
        self.plain, self.folded, self.loose = _automaton(plain), _automaton(folded), loose

    def lines(self, document: str) -> Iterator[tuple[int, int]]:
        """(excerpt, line from 1) of every hit: of its text, else of its folded words."""
        rows = [T.normal_space(T.QUOTE.sub("", x)) for x in document.splitlines()]
        starts = [0, *itertools.accumulate(len(x) + 1 for x in rows)]
        body = " ".join(rows)
        line_of = lambda at: bisect_right(starts, at, hi=len(rows))
        held = set()
        for owner, at in _hits(self.plain, body):
            held.add(owner)
            yield owner, line_of(at)
        if self.loose:
            own = T.words(body)
            pieces = [("  " if wide else " ") + w for _, wide, w in own]
            begins = [0, *itertools.accumulate(map(len, pieces))]
            for owner, at in _hits(self.folded, "".join(pieces)):
                if owner not in held:
                    yield owner, line_of(own[bisect_right(begins, at) - 1][0])


def search(excerpts: DataFrame, docs: DataFrame, loose: bool = True, block: int = 4_000_000) -> DataFrame:
    """id, path, line (from 1) of every place where an excerpt (id, text) begins in a document (path, text); `loose` looks for its folded words where its text isn't found.

    Blocks of `block` characters are made one after the other on the driver, which holds one at a time; each costs a pass over the documents.
    """
    asked = settle(before(excerpts.select("id", "text").where("text is not null").distinct(), [F.col("id"), F.col("text")], {"_upto": F.length("text")}).withColumn("_block", F.floor(F.col("_upto") / block)))
    id_type = asked.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, path string, line int"
    texts = docs.select("path", F.coalesce("text", F.lit("")).alias("text"))
    out = asked.select("id", F.lit("").alias("path"), F.lit(0).alias("line")).limit(0)
    for b in range((asked.agg(F.max("_block")).first()[0] if asked.limit(1).count() else -1) + 1):
        rows = asked.where(F.col("_block") == b).select("id", "text").collect()  # bounded by the block and one excerpt
        if rows:
            out = out.unionByName(texts.mapInArrow(_scan([r.id for r in rows], [r.text for r in rows], loose, schema), schema))
    return out


def _scan(ids: list, excerpts: list[str], loose: bool, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        searcher = Searcher(excerpts, loose)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, line in searcher.lines(text):
                    for column, x in zip(out, (ids[i], path, line), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return run
