"""Chat formatting in budgeted windows.

A conversation's turns are rendered with a template and dealt to windows of at most `budget` tokens, aligned to turns.
Prefix sums of the turns' tokens choose the spans: with g = (budget - system - history) / 2, a turn of at most g tokens goes to
the cell of the prefix sum's grid of g in which it ends, so a span holds at most 2 g tokens; a longer turn is a span of its
own (whole, and marked `oversize` if it alone is above 2 g). Every window starts with the system turn (the first one, if it has
at most `system` tokens) and with the turns before the span, as far as `history` tokens reach back into the span before it.
Repeated turns carry no loss; the mask covers each assistant turn's text once, in the window that has it new.

A turn is `<|turn|>role newline text<|end|>newline`. Control strings inside roles and texts get one more backslash after their
first character, which reading back takes away; a role's newline becomes the control string `<|nl|>`.

Everything is expressions and windows over one shuffle by conversation. A turn is new in one window and repeated in one more
at most (system turns: in all that follow), so windows grow with the turns. A conversation's own prefix sums and its digest are
sequential, so one conversation's turns meet in one task; window frames spill.

Defined results: null texts and roles are empty; turns of a conversation are ordered by turn, role, text, nulls first; rows that
repeat count each; null is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: The template's marks, and the control strings of other templates, all without their first character.
TURN, END, NEWLINE = "<|turn|>", "<|end|>", "<|nl|>"
CONTROL = r"\|(?:turn|end|nl|system|user|assistant|im_start|im_end|endoftext|eot_id)\|>|/?s>|</?SYS>>|/?INST\]"
#: Tokens that a turn costs beside its words.
OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def windows(turns: DataFrame, budget: int = 1024, system: int = 128, history: int = 128) -> DataFrame:
    """conv_id, window (from 0), formatted, loss (array of code-point spans start, stop), n_repeated, tokens, oversize.

    `tokens` are words and 4 for each turn.
    """
    cell = (budget - system - history) // 2
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    spans = Window.partitionBy("conv_id", "_span")
    rendered = Window.partitionBy("conv_id", "_window").orderBy("_kind", "_i").rowsBetween(Window.unboundedPreceding, -1)
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    placed = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumn("_tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + OVERHEAD)
        .withColumn("_i", F.row_number().over(order))
        .withColumn("_upto", F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_cell", F.when(F.col("_tokens") <= cell, F.floor((F.col("_upto") - 1) / cell)))
        .withColumn("_new", F.when(F.col("_cell") == F.lag("_cell").over(order), 0).otherwise(1))
        .withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .withColumn("_system_i", F.min(F.when((F.col("role") == "system") & (F.col("_tokens") <= system), F.col("_i"))).over(conv))
        .withColumn("_last", F.max("_span").over(conv))
        .withColumn("_rest", F.max("_upto").over(spans) - F.col("_upto") + F.col("_tokens"))
    )
    kept = F.coalesce(F.col("_i") == F.col("_system_i"), F.lit(False))
    place = lambda span, kind: F.struct(span.cast("long").alias("w"), F.lit(kind).alias("k"))
    none = F.array().cast("array<struct<w: bigint, k: int>>")
    after = F.transform(F.when(kept & (F.col("_span") < F.col("_last")), F.sequence(F.col("_span") + 1, F.col("_last"))).otherwise(F.array().cast("array<bigint>")), lambda w: place(w, 0))
    again = F.when(~kept & (F.col("_rest") <= history) & (F.col("_span") < F.col("_last")), F.array(place(F.col("_span") + 1, 1))).otherwise(none)
    body, head = escape(F.col("text")), F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n"))
    items = (
        placed.withColumn("_at", F.explode(F.concat(F.array(place(F.col("_span"), 2)), again, after)))
        .select("conv_id", F.col("_at.w").alias("_window"), F.col("_at.k").alias("_kind"), "_i", "_tokens", "role", head.alias("_head"), body.alias("_body"))
        .withColumn("_turn", F.concat("_head", "_body", F.lit(f"{END}\n")))
        .withColumn("_off", F.coalesce(F.sum(F.length("_turn")).over(rendered), F.lit(0)) + F.length("_head"))
        .withColumn("_loss", F.when((F.col("_kind") == 2) & (F.col("role") == "assistant"), F.struct(F.col("_off").alias("start"), (F.col("_off") + F.length("_body")).alias("stop"))))
    )
    parts = F.sort_array(F.collect_list(F.struct("_kind", "_i", "_turn", "_loss")))
    return (
        items.groupBy("conv_id", "_window")
        .agg(parts.alias("_parts"), F.sum(F.when(F.col("_kind") < 2, 1).otherwise(0)).alias("n_repeated"), F.sum("_tokens").alias("tokens"))
        .select(
            "conv_id", F.col("_window").alias("window"), F.array_join(F.transform("_parts", lambda p: p["_turn"]), "").alias("formatted"),
            F.filter(F.transform("_parts", lambda p: p["_loss"]), lambda x: x.isNotNull()).alias("loss"), "n_repeated", "tokens", (F.col("tokens") > budget).alias("oversize"),
        )
    )


def read_back(found: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text: the new turns of the window) and targets (the texts under the mask)."""
    raw = F.split("formatted", r"<\|end\|>\n")
    fresh = F.slice(raw, F.col("n_repeated").cast("int") + 1, F.size(raw) - 1 - F.col("n_repeated").cast("int"))
    role = lambda t: unescape(F.replace(F.substring_index(t, "\n", 1), F.lit(NEWLINE), F.lit("\n")))
    text = lambda t: unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t)))
    bare = F.transform(fresh, lambda t: F.substring(t, F.lit(len(TURN) + 1), F.length(t)))
    return found.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("chars"),
        F.transform(bare, lambda t: F.struct(role(t).alias("role"), text(t).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))).alias("targets"),
    )
