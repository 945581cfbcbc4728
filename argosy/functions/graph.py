"""Vocabulary of the claim graph, and column expressions over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds and relations in listing order, the band ladder, and which kinds each relation may join with a bearing.
KINDS = ("claim", "analysis", "experiment", "axiom", "work")
RELATIONS = ("supports", "founds", "lifts", "refutes", "references", "demoted")
SCORING = ("supports", "founds", "lifts", "refutes")
WALKED = ("supports", "lifts", "refutes")
BANDS = (("ok-to-build", 0.85), ("ok-with-caveats", 0.65), ("input-only", 0.45), ("do-not-build", 0.20), ("unsubstantiated", 0.0))
BEARING_SOURCES = {"supports": ("claim", "experiment"), "founds": ("work", "axiom"), "lifts": ("analysis", "experiment"), "refutes": ("claim", "analysis", "experiment")}
BEARING_TARGETS = ("claim", "analysis")
ID = r"^(clm|exp|ana|wrk|axm)-[a-z0-9]{6}$"
ID_TOKEN = r"\b(?:clm|exp|ana|wrk|axm)-[a-z0-9]{6}\b"
KIND_OF = {"clm": "claim", "ana": "analysis", "exp": "experiment", "axm": "axiom", "wrk": "work"}


def relation_rank(relation: Column) -> Column:
    """Place in listing order, from 0."""
    return F.array_position(F.array(*map(F.lit, RELATIONS)), relation) - 1


def scoring(relation: Column) -> Column:
    return relation.isin(*SCORING)


def band(strength: Column) -> Column:
    """The ladder's rung of a strength; unknown where it is pending."""
    out = F.when(strength.isNull(), F.lit("unknown"))
    for name, least in BANDS[:-1]:
        out = out.when(strength >= least, F.lit(name))
    return out.otherwise(F.lit(BANDS[-1][0]))


def display(x: Column) -> Column:
    """Two decimals, rounded by the exact binary value; pending as a word."""
    return F.when(x.isNull(), F.lit("pending")).otherwise(F.format_number(x, 2))


def contribution(relation: Column, bearing: Column, strength: Column) -> Column:
    """What an edge brings to its target; null where bearing or source is pending."""
    worth = bearing * strength
    return F.when(relation == "refutes", 1.0 - worth).otherwise(worth)


def bearing_text(bearing: Column, pending: Column) -> Column:
    """A number, `pending`, or null where no bearing applies."""
    return F.when(pending, F.lit("pending")).otherwise(bearing.cast("string"))


def bearing_of(text: Column) -> tuple[Column, Column]:
    """Bearing and pending of a bearing as it is written: a number in [0, 1] or the pending word; both null for anything else."""
    bare = F.trim(text)
    number, pending = bare.try_cast("double"), bare.isin("pending", "*pending*")
    fits = ~F.isnan(number) & number.between(0, 1)
    return F.when(fits, number), F.when(pending, True).when(fits, False)


def bearing_legal(relation: Column, source_kind: Column, target_kind: Column) -> Column:
    out = F.lit(False)
    for name, kinds in BEARING_SOURCES.items():
        out = out | ((relation == name) & source_kind.isin(*kinds))
    return out & target_kind.isin(*BEARING_TARGETS)


def id_kind(id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])
    return F.when(id.rlike(ID), F.element_at(names, F.substring(id, 1, 3)))


def fold(text: Column) -> Column:
    """Full case folding, in the JVM: through upper case, which spells out what lower case keeps (ß, ligatures); final sigma as sigma."""
    return F.translate(F.lower(F.upper(text)), "ς", "σ")


def judged_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each written behind its length in bytes."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)
