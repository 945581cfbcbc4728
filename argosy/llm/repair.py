"""Conversation structure repair by a min-plus matrix scan.

Turns are kept, given the role of user or assistant, or deleted, and empty turns are inserted, until the initials of the roles read
`(s?(ua)+)?`. Four states tell what was said last: nothing, system, user, assistant. Each turn is a 4x4 matrix: entry (i, j) is the cheapest
(cost, audit) of edits that lead from state i to j, insertions around the turn included (the insert closure). Matrices are
multiplied with the least of sums; of equal costs the least audit in ASCII order stays. No audit of a cost is the beginning of another of
the same cost over the same turns (all it could have more are insertions, which cost), so the order is kept under concatenation and the
product is associative.

Turns are dealt to range partitions in order, so a long conversation lies in many. Each task multiplies the turns of every conversation
it holds (by halves, short runs cached); conversations that cross partitions are reduced in a tree of bounded fan-in. The audits
are then read back to one edit a turn and joined with the turns by number, so no task holds a conversation's texts. What is seen earlier is the least
number of each (conversation, role, text hash), an aggregate.

Defined results: null texts and roles are one space (a blank text; a role that can't be kept); null is a conversation of its own; turns go by
number, nulls first, then by role, then by MD5 of the text; rows that repeat are duplicates of the first; roles count by their first
character; the roles of inserted and rerolled turns follow from the number of turns kept, so equal audits are one repair; gaps beyond a
long are held to its greatest value; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, settle

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What an undeleted truncated turn adds.
TRUNCATED = 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of an initial, by the state before.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FAN_IN, RUN = 16, 8
MOST = 2**63 - 1

Matrix = tuple  # 16 entries by rows: (cost, audit), or None where no edits lead there


class Repaired(NamedTuple):
    """A row for each conversation, and the turns that stay."""

    conversations: DataFrame
    turns: DataFrame


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product, ties to the least audit."""
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(a[i + k][0] + b[4 * k + j][0], k) for k in range(4) if a[i + k] and b[4 * k + j]]
            if ways:
                least = min(ways)[0]
                out.append((least, min(a[i + k][1] + b[4 * k + j][1] for cost, k in ways if cost == least)))
            else:
                out.append(None)
    return tuple(out)


def _closure() -> Matrix:
    out: list = [None] * 16
    for i in range(4):
        out[5 * i] = (0, "")
    for _ in range(3):  # longer runs of insertions lead back
        for i in range(4):
            for j in range(4):
                if out[4 * i + j]:
                    cost, audit = out[4 * i + j]
                    for step in ("u", "a"):
                        to = STEPS[step].get(j)
                        if to is not None:
                            way = (cost + COSTS[INSERT], audit + INSERT)
                            out[4 * i + to] = min(way, out[4 * i + to] or way)
    return tuple(out)


CLOSURE = _closure()


@functools.cache
def turn_matrix(code: int) -> Matrix:
    """The matrix of a turn: code is 3 times its initial (s, u, a, other) and 0, 1 if truncated, 2 if it has to go."""
    initial, fault = "sua?"[code // 3], code % 3
    out: list = [None] * 16
    for i in range(4):
        ways = [(COSTS[DELETE], DELETE, i)]
        if fault < 2:
            more = TRUNCATED if fault else 0
            ways += [(COSTS[KEEP] + more, KEEP, STEPS[initial][i])] if i in STEPS.get(initial, {}) else []
            ways += [(COSTS[REROLE] + more, REROLE, STEPS[r][i]) for r in "ua" if i in STEPS[r]]
        for cost, audit, to in ways:
            out[4 * i + to] = min((cost, audit), out[4 * i + to] or (cost, audit))
    return times(times(CLOSURE, tuple(out)), CLOSURE)


@functools.lru_cache(maxsize=8192)
def _short(codes: bytes) -> Matrix:
    return functools.reduce(times, (turn_matrix(c) for c in codes), CLOSURE)


def product(codes: bytes) -> Matrix:
    """The product of a run's turns, by halves."""
    if len(codes) <= RUN:
        return _short(codes)
    half = len(codes) // 2 // RUN * RUN or RUN
    return times(product(codes[:half]), product(codes[half:]))


def best(m: Matrix) -> tuple[int, str]:
    """The cheapest edits that end well: nothing is left, or an assistant spoke last."""
    return min(x for x in (m[START], m[ASSISTANT]) if x)


def roles_of(audit: str) -> list[tuple[str, str]]:
    """(edit, initial that the turn must have) for every turn that stays, in order."""
    staying = [e for e in audit if e != DELETE]
    system = len(staying) % 2
    return [(e, "s" if system and not o else "ua"[(o - system) % 2]) for o, e in enumerate(staying)]


_SEGMENT = "conv_id {id}, _part int, runs array<struct<first: long, n: long>>, first_role string, last_role string, illegal long, blank long, duplicate long, truncated long, low decimal(20,0), high decimal(20,0), n_turns long, costs array<long>, audits array<string>"
LEGAL = ("su", "ua", "au")


class _Segment:
    """Consecutive turns of one conversation: counts that join up at their ends, and the turns' codes."""

    def __init__(self, conv_id, part):
        self.conv_id, self.part, self.runs, self.codes = conv_id, part, [], bytearray()
        self.first_role = self.last_role = self.low = self.high = None
        self.illegal = self.blank = self.duplicate = self.truncated = self.n_turns = 0

    def add(self, row: int, turn: int | None, initial: str, fault: str | None) -> None:
        if self.runs and self.runs[-1][0] + self.runs[-1][1] == row:
            self.runs[-1][1] += 1
        else:
            self.runs.append([row, 1])
        if self.first_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in LEGAL
        self.last_role = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.n_turns += turn != self.high
            self.high = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.codes.append(3 * ("sua".find(initial) if initial and initial in "sua" else 3) + (0 if fault is None else 1 if fault == "truncated" else 2))

    def row(self) -> dict:
        m = product(bytes(self.codes))
        names = ("conv_id", "first_role", "last_role", "illegal", "blank", "duplicate", "truncated", "low", "high", "n_turns")
        return {n: getattr(self, n) for n in names} | {"_part": self.part, "runs": [{"first": f, "n": n} for f, n in self.runs], "costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


def joined(a: dict, b: dict) -> dict:
    """The segment of a's turns and then b's."""
    m = times(*[tuple((c, t) if t is not None else None for c, t in zip(s["costs"], s["audits"], strict=True)) for s in (a, b)])
    out = {n: a[n] + b[n] for n in ("illegal", "blank", "duplicate", "truncated", "n_turns", "runs")}
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    out["n_turns"] -= a["high"] is not None and a["high"] == b["low"]
    out |= {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "first_role": a["first_role"], "last_role": b["last_role"]}
    return out | {"conv_id": a["conv_id"], "_part": a["_part"] // FAN_IN, "costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _table(rows: list[dict], schema) -> pa.Table:
    """Rows as a table; whole numbers become decimals where the schema has them."""
    from decimal import Decimal

    rows = [r | {n: None if r[n] is None else Decimal(r[n]) for n in ("low", "high")} for r in rows]
    return pa.Table.from_pylist(rows, _arrow(schema))


def _segments(codes: DataFrame, schema) -> DataFrame:
    """One row for each conversation of each partition of sorted turns (conv_id, _row, turn, initial, fault, _part)."""

    def run(batches):
        now, done = None, []
        for batch in batches:
            for conv_id, row, turn, initial, fault, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Segment(conv_id, part)
                now.add(row, turn, initial, fault)
            if done:
                yield from _table(done, schema).to_batches()
                done = []
        if now is not None:
            yield from _table([now.row()], schema).to_batches()

    return codes.mapInArrow(run, schema)


def _reduced(segments: DataFrame, schema) -> DataFrame:
    """One segment for each conversation, by a tree over the partitions."""

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_part"])
        for r in rows:
            r["low"], r["high"] = (None if r[n] is None else int(r[n]) for n in ("low", "high"))
        head = rows[0] | {"_part": rows[0]["_part"] // FAN_IN}
        whole = functools.reduce(joined, rows) if len(rows) > 1 else head
        return _table([whole | {"_part": head["_part"]}], schema)

    segments = settle(segments)
    ends = segments.groupBy("_part").agg(F.min_by("conv_id", F.element_at("runs", 1)["first"]).alias("a"), F.max_by("conv_id", F.element_at("runs", 1)["first"]).alias("b"))
    width = (ends.agg(F.max("_part")).first()[0] or 0) + 1
    if width == 1:
        return segments
    # Only the first and the last conversation of a partition can go on in another: two rows a partition, small enough to send to all.
    parts = segments.join(F.broadcast(ends.withColumnRenamed("_part", "_of")), F.col("_part") == F.col("_of"))
    crossing = F.col("conv_id").eqNullSafe(F.col("a")) | F.col("conv_id").eqNullSafe(F.col("b"))
    inner, outer = parts.where(~crossing).select(*segments.columns), parts.where(crossing).select(*segments.columns)
    while width > 1:
        width = -(-width // FAN_IN)
        outer = outer.withColumn("_to", (F.col("_part") / FAN_IN).cast("int")).groupBy("conv_id", "_to").applyInArrow(lambda t: merged(t.drop_columns(["_to"])), schema)
    return inner.unionByName(outer)


def _form(turns: DataFrame) -> DataFrame:
    one = F.lit(" ")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text"))


def _key() -> Column:
    """A hash of the whole row, each part with its length."""
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.encode(F.concat_ws(":", null("conv_id"), null("turn"), F.length("role"), "role", "text"), "UTF-8")))


def _coded(turns: DataFrame) -> DataFrame:
    """conv_id, _row (numbers in the order of conversations and turns), turn, role, initial, fault, _key; settled, without the texts."""
    bare = F.rtrim("text", F.lit(SPACE_CHARS))
    rows = turns.select("conv_id", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("_hash"), _key().alias("_key"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    # Rows that are equal may be a third of the table: a number of their own lets the ranges part them.
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("_hash"), F.asc("_copy")]
    rows = settle(rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_copy").withColumn("_row", F.monotonically_increasing_id()))
    first = rows.groupBy("conv_id", "role", "_hash").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    return rows.join(first, "_row", "left").select("conv_id", "_row", "turn", "role", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "_key")


def _edits(found: DataFrame, id_type: str) -> DataFrame:
    """conv_id, at (number in the repaired conversation), _row (null if inserted), role (null if kept)."""
    schema = f"conv_id {id_type}, at long, _row long, role string"
    from pyspark.sql.types import _parse_datatype_string

    arrow = _arrow(_parse_datatype_string(schema))
    names = {"s": "system", "u": "user", "a": "assistant"}

    def run(batches):
        out: list[tuple] = []
        for batch in batches:
            for conv_id, audit, runs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = (row for r in runs for row in range(r["first"], r["first"] + r["n"]))
                at, staying = 0, iter(roles_of(audit))
                for edit in audit:
                    row = None if edit == INSERT else next(rows)
                    if edit != DELETE:
                        role = next(staying)[1]
                        out.append((conv_id, at, row, None if edit == KEEP else names[role]))
                        at += 1
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return found.select("conv_id", "audit", "runs").mapInArrow(run, schema)


def repair(turns: DataFrame) -> Repaired:
    """Repairs `turns` (conv_id, turn, role, text).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv_id, at (from 0), role, text.
    """
    from pyspark.sql.types import _parse_datatype_string

    turns = _form(turns)
    id_type = turns.schema["conv_id"].dataType.simpleString()
    schema = _parse_datatype_string(_SEGMENT.format(id=id_type))
    coded = settle(_coded(turns))
    ordered = coded.select("conv_id", "_row", "turn", "initial", "fault").repartitionByRange("_row").sortWithinPartitions("_row").withColumn("_part", F.spark_partition_id())
    segments = _reduced(_segments(ordered, schema), schema)
    ways = F.array_sort(F.filter(F.transform(F.array(F.lit(START), F.lit(ASSISTANT)), lambda i: F.struct(F.get("costs", i).alias("cost"), F.get("audits", i).alias("audit"))), lambda x: x["audit"].isNotNull()))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.least(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(MOST))).cast("long")
    found = settle(segments.withColumn("_best", ways[0]).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit"), "runs"))
    edits = _edits(found, id_type)
    kept = edits.where("_row is not null").join(coded.select("_row", F.col("role").alias("_own"), "_key"), "_row").select("conv_id", "at", F.coalesce("role", "_own").alias("role"), "_key")
    texts = turns.select(_key().alias("_key"), "text").groupBy("_key").agg(F.first("text").alias("text"))  # equal rows, one of which stays at most
    whole = kept.join(texts, "_key").select("conv_id", "at", "role", "text")
    return Repaired(found.drop("runs"), whole.unionByName(edits.where("_row is null").select("conv_id", "at", "role", F.lit("").alias("text"))))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256, of the conversation's lines `role:text`, joined by newlines; a conversation streams through one task, a batch at a time."""
    from pyspark.sql.types import _parse_datatype_string

    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, sha256 string"
    arrow = _arrow(_parse_datatype_string(schema))

    def run(batches):
        now, running, out = None, None, []
        for batch in batches:
            for conv_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if running is None or conv_id != now:
                    if running is not None:
                        out.append((now, running.hexdigest()))
                    now, running = conv_id, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(line.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], arrow.field(0).type), pa.array([running.hexdigest()])], schema=arrow)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.select("conv_id", F.concat_ws(":", "role", "text")).mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` with faults planted by CRC-32 of `conv_id:turn`, modulo 20: 0 drops the row, 1 empties its text, 2 takes its `.!?` away, 3 repeats it, 4 makes it a user's."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(named("conv_id"), F.lit(":"), named("turn")), "UTF-8")) % 20
    rows = _form(turns).withColumn("_fate", fate).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")
