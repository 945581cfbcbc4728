"""Strength, trace and find against worked values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from argosy.operators import query, strength

NODE = "id string, kind string, title string, label string, status string, rigor double, manually_scored boolean, host string"
EDGE = "relation string, replaced_relation string, source string, target string, context string, bearing double, bearing_pending boolean, manually_scored boolean"
SHORT = {"sup": "supports", "fnd": "founds", "lft": "lifts", "ref": "refutes", "rfs": "references", "dem": "demoted"}
KIND = {"clm": "claim", "ana": "analysis", "exp": "experiment", "wrk": "work", "axm": "axiom"}


def nodes(spark, rows):
    """Rows (id, rigor[, title, host, status])."""
    out = []
    for id, rigor, *more in rows:
        title, host, status = (*more, None, None, None)[:3]
        kind = KIND[id[:3]]
        out.append((id, kind, title or id, title if kind in ("work", "axiom") else None, status or ("run" if kind == "experiment" else None), rigor, False, host))
    return spark.createDataFrame(out, NODE)


def edges(spark, rows):
    """Rows (source, short relation, target, bearing); None is pending."""
    return spark.createDataFrame([(SHORT[r], None, a, b, "", float(x) if x is not None else None, x is None and r not in ("rfs",), False) for a, r, b, x in rows], EDGE)


STRENGTHS = {
    # claim: rigor, incoming edges, strength, trace
    "base01": (0.9, [("wrk-c", "fnd", 1)], 0.9, "min(0.90, 0.90)"), "bare01": (0.95, [], 0.0, ""), "bare02": (0.95, [("wrk-a", "fnd", 0.9)], 0.45, "min(0.95, 0.45)"),
    "weak01": (0.4, [("base01", "sup", 1)], 0.4, "min(0.40, 0.90)"), "chain1": (0.8, [("weak01", "sup", 1)], 0.4, "min(0.80, 0.40)"), "pend01": (None, [("base01", "sup", 1), ("exp-plan", "lft", 1)], None, None),
    "excl01": (0.9, [("pend01", "sup", 1)], 0.0, None), "far001": (1.0, [("excl01", "sup", 1)], 0.0, "min(1.00, 0.00)"), "lift01": (0.2, [("ana-90", "lft", 0.98)], 0.882, "max(0.00, 0.88)"),
    "rescu1": (None, [("exp-run1", "lft", 0.7)], 0.7, "lift 0.70"), "cap001": (0.9, [("wrk-c", "fnd", 1), ("ana-one", "ref", 0.2)], 0.8, "min(min(0.90, 0.90), 0.80)"),
    "cap002": (None, [("ana-one", "lft", 0.9), ("ana-one", "ref", 0.2)], 0.8, "min(lift 0.90, 0.80)"), "half01": (0.9, [("base01", "sup", 0.5)], 0.45, "min(0.90, 0.45)"),
    "both01": (0.9, [("base01", "sup", 0.6667), ("ana-one", "lft", 0.8), ("ana-one", "ref", 0.3)], 0.7, "min(max(min(0.90, 0.60), 0.80), 0.70)"),
    "axm00": (0.9, [("axm-s1", "fnd", 0)], 0.0, "min(0.90, 0.00)"), "workns": (0.9, [("wrk-b", "fnd", 1)], 0.0, None), "workpd": (0.9, [("wrk-a", "fnd", None)], 0.0, None),
    "refr01": (0.3, [("wrk-a", "fnd", 0.6)], 0.3, None), "refut1": (0.9, [("refr01", "ref", 1)], 0.0, None), "targ01": (0.8, [("wrk-c", "fnd", 1), ("refr01", "ref", 1)], 0.7, "min(min(0.80, 0.90), 0.70)"),
}


def test_strength_table(spark):
    full = lambda x: x if x[:4] in ("wrk-", "ana-", "exp-", "axm-") else f"clm-{x}"
    own = [("axm-s1", 1.0), ("wrk-a", 0.5), ("wrk-b", None), ("wrk-c", 0.9), ("exp-run1", 1.0), ("exp-plan", 1.0, None, None, "planned"), ("ana-90", 0.9), ("ana-one", 1.0)]
    rows = own + [(full(n), r) for n, (r, *_) in STRENGTHS.items()]
    ways = [("axm-s1", "fnd", "ana-90", 1), ("axm-s1", "fnd", "ana-one", 1)] + [(full(a), k, full(n), b) for n, (_, e, *_) in STRENGTHS.items() for a, k, b in e]
    derived = strength.derive(nodes(spark, rows), edges(spark, ways))
    got = {r.id: r.strength for r in derived.collect()}
    traces = {r.id: r.trace for r in strength.trace_text(derived).collect()}
    for n, (_, _, want, trace) in STRENGTHS.items():
        assert got[full(n)] == pytest.approx(want) if want is not None else got[full(n)] is None, n
        if trace is not None:
            assert traces[full(n)] == trace


def test_analyses_without_premises_and_cycles(spark):
    rows = [("clm-a", 0.8), ("ana-b", 0.7), ("ana-c", 0.9), ("clm-d", 0.5), ("clm-x", 1.0), ("clm-y", 1.0), ("clm-z", 1.0)]
    ways = [("clm-a", "sup", "ana-c", 1), ("ana-b", "lft", "clm-d", 1), ("clm-x", "sup", "clm-y", 1), ("clm-y", "sup", "clm-x", 1), ("clm-y", "sup", "clm-z", 1)]
    got = {r.id: (r.strength, r.level) for r in strength.derive(nodes(spark, rows), edges(spark, ways)).collect()}
    assert got == {"clm-a": (0.0, 1), "ana-b": (0.7, 1), "ana-c": (0.0, 2), "clm-d": (0.7, 2), "clm-x": (None, None), "clm-y": (None, None), "clm-z": (None, None)}
    none = strength.derive(nodes(spark, rows).limit(0), edges(spark, ways).limit(0))
    assert none.count() == 0


@pytest.fixture(scope="module")
def kb(spark):
    leaf, two = "main/leaf.md", "main/two.md"
    rows = [("ana-aaaaaa", 0.7, "Alpha method", leaf), ("axm-s00000", 1.0, "The scoring rule"), ("clm-aaaaaa", 0.9, "Alpha result", leaf), ("clm-bbbbbb", 0.5, "Beta result", two), ("clm-cccccc", None, "Gamma result"), ("exp-aaaaaa", 0.5, "A run", two), ("wrk-a00000", None, "Alpha book")]
    ways = [("axm-s00000", "fnd", x, 1) for x in ("clm-aaaaaa", "clm-bbbbbb", "ana-aaaaaa")] + [("clm-aaaaaa", "sup", "clm-cccccc", 1)]
    e = edges(spark, ways)
    return strength.derive(nodes(spark, rows), e).cache(), e


FINDS = [
    ({}, "ana axm a b c exp wrk"), ({"kinds": ["work", "axiom"]}, "axm wrk"), ({"title": "ALPHA"}, "ana a wrk"), ({"path": "main/leaf.md"}, "ana a"), ({"path": "main/"}, "ana a b exp"), ({"path": ""}, "ana a b exp"), ({"path": "mai"}, ""),
    ({"low": 0.7}, "ana axm a"), ({"high": 0.7}, "b exp"), ({"low": 0.0}, "ana axm a b exp"), ({"pending": True}, "c wrk"), ({"min_dependents": 1}, "axm a"), ({"sort": "id", "order": "desc"}, "wrk exp c b a axm ana"),
    ({"sort": "strength"}, "c wrk b exp ana a axm"), ({"sort": "strength", "order": "desc"}, "axm a ana b exp c wrk"), ({"sort": "dependents", "order": "desc"}, "axm a c wrk b exp ana"),
    ({"sort": "strength", "limit": 2}, "c wrk"), ({"sort": "strength", "limit": -2}, "a axm"),
]


@pytest.mark.parametrize("selection, want", FINDS)
def test_find(kb, selection, want):
    got = query.find(kb[0], **selection).collect()
    got = sorted(got, key=lambda r: r.rank) if selection.get("limit") else got
    short = {"clm-aaaaaa": "a", "clm-bbbbbb": "b", "clm-cccccc": "c"}
    assert " ".join(short.get(r.id, r.id[:3]) for r in got) == want


def test_find_refuses_bad_selections(kb):
    for bad in ({"kinds": ["clam"]}, {"sort": "size"}, {"limit": 3}, {"sort": "id", "limit": 0}, {"pending": True, "low": 0.1}):
        with pytest.raises(query.Refused):
            query.find(kb[0], **bad)


def test_trace_diamond(spark):
    rows = [("clm-a", 1.0), ("clm-b", 1.0), ("clm-c", 1.0), ("clm-d", 0.9), ("axm-s", 1.0)]
    ways = [("axm-s", "fnd", "clm-d", 1), ("clm-b", "sup", "clm-a", 1), ("clm-c", "sup", "clm-a", 0.5), ("clm-d", "sup", "clm-b", 0.5), ("clm-d", "sup", "clm-c", 0.8)]
    e = edges(spark, ways)
    n = strength.derive(nodes(spark, rows), e).cache()
    got = [(r.source[-1], r.target[-1], r.depth, round(r.strength, 4), round(r.contribution, 4)) for r in query.trace(n, e, "clm-a", "in").collect()]
    assert got == [("b", "a", 1, 0.45, 0.45), ("c", "a", 1, 0.72, 0.36), ("d", "b", 2, 0.9, 0.45), ("d", "c", 2, 0.9, 0.72), ("s", "d", 3, 1.0, 1.0)]
    out = [(r.source[-1], r.target[-1], r.depth) for r in query.trace(n, e, "clm-d", "out").collect()]
    assert out == [("d", "b", 1), ("d", "c", 1), ("b", "a", 2), ("c", "a", 2)]
    assert query.trace(n, e, "clm-a", "out").count() == 0


def test_edges_in_fixed_order(spark):
    e = edges(spark, [("clm-c", "sup", "clm-b", 0.5), ("clm-b", "sup", "clm-a", 0.5), ("ana-x", "lft", "clm-a", 0.8), ("clm-d", "sup", "clm-a", None), ("wrk-b", "fnd", "clm-a", 0.5), ("clm-a", "rfs", "clm-b", None)])
    assert [(r.source[-1], r.relation[:3], r.target[-1], r.bearing, r.bearing_pending) for r in query.edges_of(e).collect()] == [
        ("b", "sup", "a", 0.5, False), ("c", "sup", "b", 0.5, False), ("d", "sup", "a", None, True), ("b", "fou", "a", 0.5, False), ("x", "lif", "a", 0.8, False), ("a", "ref", "b", None, False),
    ]
    assert query.edges_of(e, id="clm-b", direction="in").count() == 2
    assert query.relation_census(e).where(F.col("n") == 0).count() == 2
