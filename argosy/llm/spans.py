"""Columns over arrays of spans struct<kind, start, stop>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("k"), s["stop"].alias("b"), s["kind"].alias("n"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["n"], s["a"], s["b"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
