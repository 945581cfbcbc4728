"""Queries over whole tables that no SQL covers, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from argosy.functions.graph import RELATIONS
from argosy.operators import build, graph, render, shortlist
from argosy.plans import building, catalog, files, star, texts  # noqa: F401
from argosy.sources import load

from . import brute

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def _quoted(x):
    return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'


def test_canonical_terms_take_markup_and_maths(spark, tmp_path):
    texts = ["plain words here", "A <b>bold</b> contraction bound", "operator $`\\lambda_{c}`$ holds", "```\nfenced code\n```\nafter all"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_terms for r in catalog.QUERIES["canonical_terms"](spark, str(tmp_path)).collect()}
    # plain words here; bold contraction bound; operator lambda m:\lambda_c holds; code is text to canonical()
    assert sorted(got) == [0, 1, 2, 3] and got[1] == 3 and got[2] == 4


def _entry(row, fields):
    """A record by its rule: ids and names bare, numbers as Python spells them or pending, other texts quoted, what is missing as its empty value."""
    lines = []
    for name in fields:
        x = row.get(name.replace("-", "_"))
        if name in ("rigor", "bearing"):
            text = '"*pending*"' if x is None else repr(x)
        elif name == "manually-scored":
            text = str(bool(x)).lower()
        elif name in ("id", "source", "target", "relation", "replaced-relation", "status"):
            text = x or ""
        else:
            text = _quoted(x or ("0" * 64 if name == "judged-hash" else ""))
        lines.append(f"{name}: {text}")
    return "- " + "\n  ".join(lines)


def _joined(df, by):
    """The texts of files in parts."""
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r.part):
        out[r[by]].append(r.text)
    return {k: "\n".join(v) for k, v in out.items()}


@tables
def test_edge_file_holds_every_edge(spark):
    want = defaultdict(list)
    place = lambda e: (e.replaced_relation is not None and RELATIONS.index(e.replaced_relation), e.source, e.target)
    for e in sorted(star.snapshot(spark, SF).edges.collect(), key=place):
        want[e.relation].append(_entry(e.asDict(), render.EDGE[e.relation]))
    got = _joined(catalog.QUERIES["edge_file"](spark, SF), "relation")
    assert set(got) == set(RELATIONS) and got == {k: "\n".join(v) for k, v in want.items()}


@tables
def test_record_file_holds_every_node(spark):
    want = defaultdict(list)
    for n in sorted(star.snapshot(spark, SF).nodes.collect(), key=lambda n: n.id):
        want[n.kind].append(_entry(n.asDict(), render.RECORD[n.kind]))
    got = _joined(catalog.QUERIES["record_file"](spark, SF), "kind")
    assert set(got) == {"claim", "analysis", "experiment", "axiom", "work"} and got == {k: "\n".join(v) for k, v in want.items()}


def test_stored_files_go_with_their_plans(spark, monkeypatch):
    monkeypatch.setattr(star, "COLLECT", 0)
    held = star.stored(spark.range(1000).selectExpr("id", "id % 7 as k"))
    _, _, files, path = star._STORED[-1]
    rest = held.where("k = 3")
    del held
    star.stored(spark.range(1))
    assert rest.count() == 143 and files.exists(path)  # a plan still reads it
    del rest
    for _ in range(20):
        star.stored(spark.range(1)).count()
        if not files.exists(path):
            return
    raise AssertionError("a table that nothing reads stays on disk")


@tables
@pytest.mark.parametrize("name", ("unknown_ids", "own_equations", "edge_file", "loaded_nodes"))
def test_records_are_read_without_deriving(spark, monkeypatch, name):
    monkeypatch.setattr(star, "_HELD", {})
    monkeypatch.setattr(star, "snapshot", None)
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_neighbours_are_not_sent_to_the_driver(spark, tmp_path):
    """A join of all places isn't taken for small by the size of compressed files."""
    spark.range(100_000).selectExpr("concat('clm-', hash(id)) as id", "concat('d', id % 3) as document", "'p' as paper", "id as seq").write.parquet(str(tmp_path / "p"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, 3 * sum(p.stat().st_size for p in (tmp_path / "p").glob("*.parquet")))
    try:
        plan = build._beside(spark.read.parquet(str(tmp_path / "p")), "document", 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, held)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pairs_of_blocks_make_no_copies(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        placed = spark.range(60).selectExpr("cast(id / 6 as int) as block", "cast(id as string) as id", "1L as want", "0.0D as floor", "array(id) as terms", "array(1.0D) as ws")
        pairs = shortlist._pairs(star.stored(placed))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == 100 and "CartesianProduct" in plan and "Generate" not in plan
    finally:
        spark.conf.set(key, held)


@tables
def test_sorted_lines_are_stored_small(spark):
    """Pages and sheets keep no table of rows beside their compressed lines."""
    folder = Path(star._folder(spark.range(1)).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file() and "rdd-" in str(p))
    held = star.snapshot(spark, SF)
    before = size()
    out = [render.pages(*held), render.sheet(*held)]
    assert size() - before < 100_000 and all(x.limit(1).count() for x in out)


def test_parsed_parts_meet_in_small_batches(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    real = load.T.udf

    def udf(fn, kind):
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            seen.add(int(len(s) > load.BATCH))
            return s.map(fn)

        return run

    monkeypatch.setattr(load.T, "udf", udf)
    parts = spark.range(40).selectExpr("'claim' as file", "cast(id as int) as part", "concat('- id: clm-', id, '\n  title: \"x\"\n- id: b\nodd') as text").coalesce(1)
    rows, faults = load.records_of(parts)
    monkeypatch.setattr(load.T, "udf", real)
    assert (rows.count(), faults.count(), seen.value) == (80, 40, 0)
    assert sorted(r.fields["id"] for r in rows.where("part = 7").collect()) == ["sb", "sclm-7"]


def _graphs(n, size, edges, relations=("supports",)):
    rng = random.Random(7)
    return [sorted({(rng.choice(relations), f"g{g:02d}{rng.choice(size)}", f"g{g:02d}{rng.choice(size)}") for _ in range(rng.randint(*edges))}) for g in range(n)]


def test_reduction_of_any_size(spark):
    graphs = _graphs(40, "abcdefghi", (4, 26)) + [[("supports", "xa", "xa"), ("founds", "xa", "xb")]]
    graphs += [[("supports", f"z{a}", f"z{b}") for a, b in ("ab", "bc", "cd", "ad", "ac", "de", "ce", "fe")]]
    want = sorted(p for g in graphs for p in graph.reduced([(a, b) for r, a, b in g if r == "supports"]))
    held = graph.KERNEL_EDGES
    graph.KERNEL_EDGES = 10  # the edges of all graphs were refused above this many
    try:
        out = graph.transitive_reduction(spark.createDataFrame([e for g in graphs for e in g], "relation string, source string, target string")).collect()
    finally:
        graph.KERNEL_EDGES = held
    assert sorted((r.source, r.target) for r in out if r.relation == "supports") == want and ("xa", "xa") in want
    assert sum(r.relation == "founds" for r in out) == 1


def test_cuts_by_first_edges():
    for g in _graphs(300, "abcdefg", (3, 18), ("supports", "founds", "lifts", "refutes")):
        ids = sorted({x for e in g for x in e[1:]})
        for kinds in ({}, {x: "analysis" for x in ids[::2]}):
            rank = {x: i for i, x in enumerate(reversed(ids[1:4]))}
            assert [cut for _, cut in graph.cuts_by_start(g, rank, kinds)] == brute.cycle_cuts(g, rank, kinds)


@pytest.mark.parametrize("kernel", (100, 3))
def test_cuts_go_by_the_number_of_longer_ids(spark, monkeypatch, kernel):
    monkeypatch.setattr(graph, "KERNEL_EDGES", kernel)
    rings = [(f"clm-c{n}", f"clm-c{n + 1}", f"clm-c{n + 2}", f"clm-c{n + 3}") for n in (100000, 99996, 100004, 99992)]
    rows = spark.createDataFrame([("supports", r[i], r[(i + 1) % 4]) for r in rings for i in range(4)], "relation string, source string, target string")
    got = [(r.source, r.target) for r in graph.cycle_cuts(rows, spark.createDataFrame([], "id string, kind string")).orderBy("rank").collect()]
    assert got == [(f"clm-c{n + 3}", f"clm-c{n}") for n in (99992, 99996, 100000, 100004)]


def test_cuts_of_cores_beyond_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(graph, "KERNEL_EDGES", 3)
    g = [("founds", "u", "v"), ("supports", "v", "w"), ("supports", "w", "a"), ("supports", "a", "b"), ("lifts", "b", "a"), ("refutes", "b", "c"), ("supports", "c", "w"), ("lifts", "w", "c")]
    rows = spark.createDataFrame([*g, ("references", "b", "u"), g[3]], "relation string, source string, target string")
    nodes = spark.createDataFrame([(x, "analysis" if x in "bw" else "claim") for x in "abcuvw"], "id string, kind string")
    got = [tuple(r)[1:] for r in graph.cycle_cuts(rows, nodes, ["v", "c"]).orderBy("rank").collect()]
    assert got == brute.cycle_cuts(g, {"v": 0, "c": 1}, {"b": "analysis", "w": "analysis"}) and len(got) == 2


def _sheet(nodes, edges, volume):
    """A sheet by brute force: (id, host, title) and (relation, source, target); the full sheet for ""."""
    names = {i: t for i, _, t in nodes}
    own = {i for i, h, _ in nodes if not volume or (h or "").startswith(volume + "/")}
    drawn = sorted({e for e in edges if e[0] != "references" and (not volume or {e[1], e[2]} & own)}, key=lambda e: (e[1], e[2], e[0]))
    kept = graph.reduced([e[1:] for e in drawn if e[0] == "supports"])
    shown = own | {x for e in drawn for x in e[1:]}
    lines = [f'  "{i}" [label="{names[i]} 0.12"];' for i in sorted(shown) if i in names] + [f'  "{i}" [style="dashed" label="{i}"];' for i in sorted(shown) if i not in names]
    lines += [f'  "{a}" -> "{b}" [style={render.STROKES[r]}];' for r, a, b in drawn if r != "supports" or (a, b) in kept]
    return "\n".join(["digraph claims {", *lines, "}", ""])


def test_sheets_draw_across_volumes(spark):
    nodes = [("clm-a", "v/x.md", "A"), ("clm-b", "v/y.md", "B"), ("clm-c", "w/x.md", "C"), ("clm-d", "w/x.md", "D"), ("clm-e", "u/x.md", "E"), ("wrk-a", None, "Work"), ("clm-lone", "v/x.md", "Lone")]
    edges = [("supports", *x.split()) for x in ("clm-a clm-b", "clm-b clm-c", "clm-a clm-c", "clm-c clm-d", "clm-b clm-d", "clm-e clm-d", "clm-d clm-gone")]
    edges += [("founds", "wrk-a", "clm-a"), ("references", "clm-a", "clm-e"), ("demoted", "clm-d", "clm-a"), ("lifts", "clm-c", "clm-d"), ("refutes", "clm-x", "clm-b"), edges[0]]
    n = spark.createDataFrame([(*x, 0.125) for x in nodes], "id string, host string, title string, strength double")
    e = spark.createDataFrame(edges, "relation string, source string, target string")
    got = {r.volume: r.dot + "\n" for r in render.sheet(n, e).unionByName(render.full_sheet(n, e)).collect()}
    assert got == {v: _sheet(nodes, edges, v) for v in ("", "u", "v", "w")}
    assert '"clm-b" -> "clm-c"' in got["v"] and '"clm-a" -> "clm-c"' not in got["v"] and "clm-gone" in got["w"]


def cosines(df):
    """Every ordered pair's cosine with a common term, from the vectors."""
    vectors = {}
    for r in shortlist.weights(shortlist.term_rows(df), df).collect():
        vectors.setdefault(r.id, {})[r.term] = r.w
    dot = lambda a, b: sum(w * b[t] for t, w in a.items() if t in b)
    return {(a, b): round(dot(x, y), 12) for a, x in vectors.items() for b, y in vectors.items() if a != b and x.keys() & y.keys()}


@pytest.mark.parametrize("k", [1, 3])
def test_best_cosines_by_blocks(spark, k):
    rng = random.Random(31)
    texts = [" ".join(["common"] * rng.randrange(2) + rng.choices([f"word{i}" for i in range(60)], k=rng.randrange(1, 12))) for _ in range(70)] + ["the same text again"] * 12 + ["common", "common common", "", "of the", None]
    df = spark.createDataFrame([(f"t{i:03d}", t) for i, t in enumerate(texts)], "id string, text string")
    known = cosines(df)
    shut = {("t001", f"t{i:03d}") for i in range(2, 40)} | {("t071", "t070"), ("t071", "t072")}
    closed = shut | {(b, a) for a, b in shut}
    pairs = spark.createDataFrame(sorted(closed), "a string, b string")
    for block in (2048, 7):
        got = {}
        for r in shortlist.top_cosines(df, k, pairs, block=block).collect():
            got.setdefault(r.a, []).append((r["rank"], r.b, r.cosine))
        for a in {a for a, _ in known}:
            best = sorted(((-c, b) for (x, b), c in known.items() if x == a and (a, b) not in closed))[:k]
            assert [(b, pytest.approx(c, abs=2e-12)) for _, b, c in sorted(got.get(a, []))] == [(b, -c) for c, b in best]


@pytest.mark.parametrize("k", [2, 4])
def test_shortlists_fill_up_beside_excluded_pairs(spark, k):
    texts = {"a": "compact operator bound", "b": "compact operator norm", "c": "graph colouring", "d": "prime sieve", "e": "graph minors", "f": "heat flow", "g": "knot group"}
    shut = [("a", "b"), ("c", "a"), ("d", "a"), ("d", "b"), ("d", "c"), ("d", "e"), ("a", "b")]
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    cosine = cosines(df)
    for pairs in ([], shut):
        closed = {p for a, b in pairs for p in ((a, b), (b, a))}
        want = []
        for a in texts:
            others = sorted((b for b in texts if b != a and (a, b) not in closed), key=lambda b: (-cosine.get((a, b), 0.0), b))
            want += [(a, i + 1, b, cosine.get((a, b), 0.0)) for i, b in enumerate(others[:k])]
        exclude = spark.createDataFrame(pairs, "a string, b string") if pairs else None
        assert sorted(map(tuple, build.tfidf_shortlist(df, k, exclude).collect())) == want
