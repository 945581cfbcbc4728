"""Text, graph kernels, builds, scoring, writes, sources, migration, streaming, and every catalog query against its SQL."""

from __future__ import annotations

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from argosy.functions import graph as G
from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.plans import everything as catalog
from argosy.operators import build, graph, migrate, render, score, verify, write
from argosy.operators.query import Refused

from argosy.sources import records
from argosy.streaming import ledger

from .test_strength import edges, nodes

SF = "/root/testdata/sf0.001"


def test_terms_and_canonical_form():
    assert T.terms("The contraction bound holds for the operator $`\\lambda_{c}`$.") == ["contraction", "bound", "holds", "operator", "lambda", "m:\\lambda_c"]
    assert T.canonical("A <b>Bold</b> [link](x.md)  -- *É*") == "a bold link  é"
    assert T.normal_space(" a\u0085b\tc ") == "a b c"


def test_code_links_and_markers():
    text = "`a` [x](y.md \"clm-aaaaaa\")\n```\n[no](z.md)\n```\n``a ` b`` clm-bbbbbb\n<!-- node-id: clm-cccccc -->"
    assert [x[1] for line in T.strip_code(text).splitlines() for x in T.links(line)] == ["y.md"]
    assert T.bare_ids(T.strip_code(text).splitlines()[4]) == ["clm-bbbbbb"]
    assert T.markers(text) == [("clm-cccccc", 5, text.index("<!--"))]
    assert T.fences(["> ```", "> x", "y", "~~~", "z"]) == [(0, 2, ""), (3, 5, "")]
    assert T.bare_ids("[clm-aaaaaa](x) [see clm-bbbbbb](y)") == ["clm-aaaaaa"]


def test_slugs_sentences_paths_excerpts():
    assert T.slugs(["A — B", "A", "A", "A-1"]) == ["a--b", "a", "a-1", "a-1-1"]
    assert T.sentences("See Fig. 2 for it. Then $a. B$ ends. Dr. No left") == ["See Fig. 2 for it.", "Then $a. B$ ends.", "Dr. No left"]
    assert T.resolved("a/b.md", "../c.md#x") == ("c.md", "x") and T.resolved("a/b.md", "#x") == ("a/b.md", "x") and T.resolved("a/b.md", "https://x.y") == ("", "")
    assert [T.locality("p/a.md", x) for x in ("p/a.md", "p/b.md", "p/q/c.md", "z/a.md")] == ["document", "directory", "paper", "cross"]
    assert T.excerpt_lines("one\ntwo words\nthree", "words three") == [2]
    assert T.excerpt_lines("one\nTwo, *words*\nthree", "two words") == [2]
    assert T.excerpt_lines("one", "absent") == []


def test_markdown_structure():
    text = "[Up](../index.md)\n# A\nbody\n## B\nx <!-- node-id: clm-bbbbbb -->\n# C\n- [one](one.md) and [two](sub/two.md)\n- [one](one.md)\n"
    assert M.section(text, "a") == "body\n## B\nx <!-- node-id: clm-bbbbbb -->" and M.section(text, "z") is None
    assert M.statement(text, "clm-bbbbbb") == "x" and M.statement(text, "clm-cccccc") == ""
    assert M.child_list("v/index.md", text) == ["v/one.md", "v/sub/two.md"] and M.up_link("v/index.md", text) == "index.md"
    assert M.title("word " * 40, 3, set()).endswith("…") and M.title("A", 2, {"A"}) == "A (¶2)"
    assert M.names_no_premise("Figs.") is False and M.names_no_premise("Sections") and M.opens_claim("one two three four", 3, [(5, 7)]) and not M.opens_claim("one two", 0, [])
    assert M.bibliography("[Kn97] Knuth.\n- [B] x") == ["Kn97", "B"] and M.citation_keys("see [@a; @b-c]") == ["a", "b-c"]
    assert M.runs_within(["b", "c"], ["a", "b", "c"]) and not M.runs_within(["c", "b"], ["a", "b", "c"])
    assert M.add_citation("x beta y", 1, "beta", "b.md", "clm-bbbbbb") == 'x [beta](b.md "clm-bbbbbb") y'
    assert M.cite_bare_ids("see clm-bbbbbb", {"clm-bbbbbb": "Beta"}, {"clm-bbbbbb": "b.md"}) == 'see [Beta](b.md "clm-bbbbbb")'
    assert M.move_marker(M.add_marker("a\nb", 1, "clm-bbbbbb"), 2, "clm-bbbbbb") == "a\nb <!-- node-id: clm-bbbbbb -->"
    assert M.repoint("[x](a.md) [y](b.md)", {"a.md": "c.md"}) == "[x](c.md) [y](b.md)" and M.link_to("a/b/c.md", "a/d.md", "x") == "../d.md#x"


def test_cycles_and_reduction():
    cut = lambda *a: [c for _, c in graph.cuts_by_start(*a)]
    kinds = {}
    ring = [("founds", "w", "a"), ("supports", "a", "b"), ("supports", "b", "a")]
    assert cut(ring, {}, kinds) == [("supports", "b", "a")]
    assert cut(ring[1:], {"b": 0, "a": 1}, kinds) == [("supports", "a", "b")]
    assert cut([("supports", "a", "b"), ("lifts", "b", "a")], {}, {"b": "analysis"}) == [("supports", "a", "b")]
    pair = lambda s: [tuple(x) for x in s.split()]
    for given, want in (("ab ac bc", "ab bc"), ("ab ad bc cd", "ab bc cd"), ("ab ac bd cd", "ab ac bd cd"), ("ab ac ba bc", "ab ba bc")):
        assert graph.reduced(pair(given)) == pair(want)


def test_graph_loops(spark):
    e = edges(spark, [("a", "sup", "b", 1), ("b", "sup", "c", 1), ("c", "sup", "b", 1), ("x", "sup", "a", 1)])
    assert {r.id: r.level for r in graph.levels(e).collect()} == {"x": 0, "a": 1, "b": None, "c": None}
    assert graph.shortest_path(e, "x", "c") == ["x", "a", "b", "c"] and graph.shortest_path(e, "c", "x") is None
    assert {(r.source, r.target) for r in graph.cyclic_core(e.select("source", "target")).collect()} == {("x", "a"), ("a", "b"), ("b", "c"), ("c", "b")}


def test_neighbours_are_linked_at_every_place(spark):
    placed = spark.createDataFrame([("x", "m", 1), ("y", "m", 2), ("x", "n", 1), ("y", "n", 5), ("z", "n", 6), ("z", "n", 7)], "id string, document string, line int")
    marked = spark.createDataFrame([("a", "b")], "a string, b string")
    assert sorted(map(tuple, build.adjacent_links(placed, marked).collect())) == [("x", "y"), ("x", "y"), ("y", "z"), ("z", "z")]
    assert sorted(map(tuple, build.adjacent_links(placed, spark.createDataFrame([("x", "y")], "a string, b string")).collect())) == [("y", "z"), ("z", "z")]


def test_culls_break_rings(spark):
    answers = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "q"), ("z", "a")], "culled string, into string")
    prose = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    places = spark.createDataFrame([(x, i) for i, x in enumerate("bacdeqz")], "id string, position int")
    got = {r.id: r.into for r in build.cull_targets(answers, prose, places).collect()}
    # z isn't prose, so a is culled into z or b, whichever comes first: b; the ring a-b-c gives way at b.
    assert got == {"a": "b", "c": "a", "d": "c", "e": "q"}
    assert {r.id: r.root for r in build.cull_roots(spark.createDataFrame(list(got.items()), "id string, into string")).collect()} == {"a": "b", "c": "b", "d": "b", "e": "q"}


def test_prices_and_answers(spark):
    df = spark.createDataFrame([(["flt-overreach"] * 3, "statement"), (["flt-overreach"] * 8, "statement"), ([], "method"), (["flt-pending"], "bearing"), (["flt-transfer", "unknown"], "bearing")], "f array<string>, v string")
    assert [r[0] for r in df.select(score.price(F.col("f"), F.col("v"))).collect()] == [0.55, 0.0, 1.0, None, 0.9]
    lines = score.closed_text([("a", "One\ntwo\n\nthree"), ("", "Label"), ("b", "Four")])
    cases = {"": "empty-reply", "  \n": "empty-reply", "prose here": "not-a-charge-line", "0.5": "bare-number", "flt-transfer: 1": "id-not-offered", "flt-overreach": "id-without-line", "flt-overreach: x": "field-names-no-line", "flt-overreach: 9": "line-not-shown", "flt-overreach: 2-1": "range-backwards", "flt-overreach: 2-3": "range-crosses-gap", "flt-overreach: 3-4": "range-crosses-parts", "flt-overreach: 1\nnone": "none-beside-charges", "flt-overreach: 1\nflt-overreach: 1-2": "overlapping-ranges"}
    assert {k: score.parse_answer(k, lines, "statement")[1] for k in cases} == cases
    assert score.parse_answer("flt-overreach: 1\nflt-overreach: 1", lines, "statement") == ([("flt-overreach", 1, 1)], "")
    wide = "word " * 40 + "$" + "x " * 60 + "$ end"
    assert "".join(score.wrap(wide)) == wide and any(len(x) > 100 for x in score.wrap(wide))


def test_write_batches(spark):
    state = write.State(nodes(spark, [("clm-aaaaaa", 0.5), ("clm-bbbbbb", 0.5), ("wrk-aaaaaa", 0.9, "Book")]), edges(spark, [("clm-aaaaaa", "sup", "clm-bbbbbb", 0.5)]))
    after = write.batch(state, [{"op": "add-claim", "id": "clm-cccccc", "title": "C", "rigor": 0.4}, {"op": "add-edge", "relation": "founds", "source": "wrk-aaaaaa", "target": "clm-cccccc", "bearing": 1.0}, {"op": "demote-claim-edge", "relation": "supports", "source": "clm-aaaaaa", "target": "clm-bbbbbb"}, {"op": "add-edge", "relation": "supports", "source": "clm-bbbbbb", "target": "clm-aaaaaa", "bearing": 0.3}])
    assert after.nodes.count() == 4 and sorted(r.relation for r in after.edges.collect()) == ["demoted", "founds", "supports"]
    for bad in ({"op": "add-edge", "relation": "supports", "source": "clm-bbbbbb", "target": "clm-aaaaaa", "bearing": 1.0}, {"op": "add-edge", "relation": "founds", "source": "clm-aaaaaa", "target": "clm-bbbbbb", "bearing": 1.0}, {"op": "add-claim", "id": "clm-aaaaaa"}, {"op": "fly"}, {"op": "remove-edge", "relation": "lifts", "source": "x", "target": "y"}):
        with pytest.raises(Refused):
            write.batch(state, [bad])
    diff = write.dry_run(state, [{"op": "edit-claim", "id": "clm-aaaaaa", "rigor": 0.9}]).collect()
    assert sorted((r.lost, r.added) for r in diff) == [(0, 1), (1, 0)] and json.loads(next(r.row for r in diff if r.added))["manually_scored"]
    gone = write.batch(state, [{"op": "remove-node", "id": "clm-aaaaaa"}])
    assert gone.nodes.count() == 2 and gone.edges.count() == 0


def test_sources(spark, tmp_path):
    good = records.load_nodes(spark, {"claim": "- id: clm-aaaaaa\n  title: \"A \\\"q\\\"\"\n  rigor: *pending*\n  manually-scored: false\n  rationale: ''\n  judged-hash: 0\n".replace("*pending*", '"*pending*"'), "axiom": "- id: axm-s00000\n  label: S0\n  title: Rule\n"})
    assert [(r.id, r.rigor, r.title) for r in good.orderBy("id").collect()] == [("axm-s00000", 1.0, "Rule"), ("clm-aaaaaa", None, 'A "q"')]
    with pytest.raises(records.Faulty) as refused:
        records.load_nodes(spark, {"axiom": "- id: bad\n  label: S0\n  extra: 1\n"})
    assert len(refused.value.faults) == 3
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("# A\n")
    (tmp_path / "docs" / "sub" / "b.md").write_text("# B\n")
    found = records.documents(spark, str(tmp_path / "docs"))
    assert sorted(r.path for r in found.collect()) == ["a.md", "sub/b.md"]
    over = records.overlay(found, spark.createDataFrame([("a.md", "new")], "path string, text string"), spark.createDataFrame([("sub/b.md",)], "path string"))
    assert [(r.path, r.text) for r in over.collect()] == [("a.md", "new")]
    lines = [{"item": "i", "status": "done", "ended": "2024-01-01T00:00:00Z", "digest": "d", "started": "s"}]
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger" / "a.json").write_text(json.dumps(lines[0]) + "\n{\"item\": \"torn")
    assert records.ledger(spark, str(tmp_path / "ledger")).count() == 1


def test_streaming_ledger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i, s, e: json.dumps({"item": i, "status": s, "started": "s", "ended": e, "digest": "d"})
    (tmp_path / "in" / "a.json").write_text("\n".join([line("i", "failed", "2024-01-01T00:00:00Z"), line("i", "done", "2024-01-01T01:00:00Z"), line("i", "failed", "2024-01-01T00:00:00Z")]))
    q = ledger.once(ledger.ledger_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
    q = ledger.last_states(ledger.ledger_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("last").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[:2] for r in spark.table("last").collect()] == [("i", "done")]


def test_migration(spark):
    assert migrate.minted("old", "clm", set()) == migrate.minted("old", "clm", set()) != migrate.minted("old", "clm", {migrate.minted("old", "clm", set())})
    files = spark.createDataFrame([("a.md", "see arg-abc123")], "path string, text string")
    steps = {(1, 0): ((2, 0), lambda f: migrate.rename_register(f, {"arg": "ana"})), (2, 0): ((3, 0), lambda f: f)}
    assert migrate.chain(files, "1.0.2", "3.0", steps).first().text == "see ana-abc123"
    with pytest.raises(ValueError):
        migrate.chain(files, "4.0", "3.0", steps)
    e = edges(spark, [("a", "sup", "b", 1)])
    assert migrate.rename_ends(e, spark.createDataFrame([("a", "z")], "old string, new string")).first().source == "z"


def test_rendering_writes_only_what_changed(spark):
    want, have = (spark.createDataFrame(rows, "path string, text string") for rows in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "x"), ("c", "3")]))
    assert sorted((r.path, r.action) for r in render.changed_files(want, have).collect()) == [("b", "write"), ("c", "remove")]
    assert sorted((r.subject, r.detail) for r in verify.stale_pages(want, have).collect()) == [("b", "stale"), ("c", "extra")]
    n = nodes(spark, [("clm-aaaaaa", 0.5, 'say "hi"', "v/x.md")]).withColumn("strength", F.lit(0.125))
    assert render.sheet(n, edges(spark, [("a", "sup", "b", 1)])).first().dot == 'digraph claims {\n  "clm-aaaaaa" [label="say \\"hi\\" 0.12"];\n}'


def test_expressions(spark):
    row = spark.range(1).select(G.band(F.lit(0.85)), G.band(F.lit(0.1)), G.band(F.lit(None).cast("double")), G.display(F.lit(0.125)), G.display(F.lit(0.135)), G.fold(F.lit("Straße ΣΑΣ")), G.id_kind(F.lit("exp-abc123")), G.judged_hash(F.lit("é"))).first()
    assert row[:7] == ("ok-to-build", "unsubstantiated", "unknown", "0.12", "0.14", "strasse σασ", "experiment")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", catalog.QUERIES)
def test_catalog(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        assert sorted(str(tuple(r)) for r in rows) == sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())
    else:
        assert rows
