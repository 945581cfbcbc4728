"""Documents, loading, derivation, rendering in parts, asks, stages and writes: small tables with worked results."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from argosy.functions import graph as G
from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.operators import asks, build, derive, documents, render, score, stages, verify, write
from argosy.operators.prefix import before
from argosy.operators.query import Refused
from argosy.sources import load, records, results

from . import brute


def test_running_sums_follow_the_whole_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), i, rng.randrange(9)) for i in range(300)] + [(None, 300, 4)]
    got = {r.i: (r.upto, r.at) for r in before(spark.createDataFrame(rows, "k long, i long, n long"), [F.col("k").asc_nulls_first(), F.col("i")], {"upto": F.col("n"), "at": F.lit(1)}).collect()}
    upto = 0
    for at, (_, i, n) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        assert got[i] == (upto, at)
        upto += n


def test_sentences_and_words_are_linear():
    import time

    text = "Some words of text. And e.g. more of it `code` and $x$ here! " * 20_000
    began = time.time()
    assert len(T.sentences(text)) > 20_000 and T.canonical(text).startswith("some words") and len("".join(score.wrap(text))) == len(text)
    assert T.blank_inline("`" * 100_000 + "a" + "`" * 99_999) and len(T.slugs(["# A"] * 20_000)) == 20_000
    assert time.time() - began < 30


def test_formulas_hold_their_spaces():
    assert score.formulas("a $b c$ d $$e f$$ g") == [(2, 7), (10, 17)]
    assert score.formulas("costs $5 alone") == [] and score.formulas(r"\$a b$ c") == []
    assert score.wrap("aa bb $c d$ ee", 6) == ["aa bb ", "$c d$ ", "ee"]
    assert score.wrap("", 5) == [""] and score.wrap("abcdefgh ij", 5) == ["abcdefgh ", "ij"]


def test_scalars_and_blocks():
    text = "- id: clm-aaaaaa # a comment\n  title: \"a # b\\\"c\" # d\n  rationale: |\n    one\n    two\n  context: >-\n    a\n    b\n\n    c\n  rigor: 1e-3\n  manually-scored: true\n- id: 'it''s'\n  title: {}\nodd\n"
    rows, faults = records.parse_scalars(text)
    assert rows[0] == {"id": "sclm-aaaaaa", "title": 'sa # b"c', "rationale": "sone\ntwo\n", "context": "sa b\nc", "rigor": "n1e-3", "manually-scored": "btrue"}
    assert rows[1] == {"id": "sit's", "title": "x{}"} and len(faults) == 1
    assert records.parse_records('- id: a\n  id: b\n')[1] == ["line 2: id twice, or before a record"]


def test_load_finds_every_fault(spark):
    part = lambda rows: spark.createDataFrame(rows, "file string, part int, text string")
    hashed = "0" * 64
    claim = f'- id: clm-aaaaaa\n  title: "A"\n  rigor: 0.5\n  manually-scored: false\n  rationale: ""\n  judged-hash: "{hashed}"'
    good = part([("claim", 0, claim), ("axiom", 0, '- id: axm-aaaaaa\n  label: "S"\n  title: "T"')])
    edges = part([("founds", 0, '- relation: founds\n  source: axm-aaaaaa\n  target: clm-aaaaaa\n  context: ""\n  bearing: "*pending*"'), ("references", 0, "[]")])
    n, e, faults = load.load(good, edges)
    assert faults.count() == 0 and n.count() == 2 and e.first().bearing_pending is True
    assert {r.id: r.rigor for r in load.graph(good, edges)[0].collect()} == {"clm-aaaaaa": 0.5, "axm-aaaaaa": 1.0}
    bad = part([("claim", 0, claim.replace("0.5", "1.5").replace("false", "maybe") + "\n  colour: red\n" + claim.replace('"A"', "7")), ("work", 0, "- id: clm-bbbbbb\n  label: \"L\"\n  title: \"T\"\n  rigor: .nan\n  rationale: x\nnonsense")])
    worse = part([("founds", 0, '- relation: founds\n  source: axm-zzzzzz\n  target: clm-aaaaaa\n  context: ""\n  bearing: 2'), ("odd", 0, "- relation: odd\n  source: a")])
    got = {(r.check, r.detail) for r in load.load(bad, worse)[2].collect()}
    assert got >= {("outside [0, 1]", "rigor"), ("not true or false", "manually-scored"), ("unknown field", "colour"), ("not a text", "title"), ("duplicate node", "2"), ("bad id", "clm-bbbbbb"), ("outside [0, 1]", "bearing"), ("unknown kind", "odd"), ("dangling", "source axm-zzzzzz")}
    assert any(c == "form" for c, _ in got)
    with pytest.raises(records.Faulty):
        load.graph(bad, edges)


def test_files_and_ledgers(spark, tmp_path):
    for path, text in (("index.md", "# I\n- [a](v/index.md)"), ("v/index.md", "- [l](leaf.md)"), ("v/leaf.md", "x"), (".git/h.md", "x"), ("node_modules/n.md", "x")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    docs = records.documents(spark, str(tmp_path))
    assert {r.path: r.text for r in docs.collect()}["index.md"].count("\n") == 1 and docs.count() == 3
    kinds = {r.path: (r.kind, r.volume) for r in records.kinds_of(docs, derive.child_lists(docs)).collect()}
    assert kinds == {"index.md": ("entry-point", None), "v/index.md": ("index", "v"), "v/leaf.md": ("leaf", "v")}
    ledger = tmp_path / "ledger"
    ledger.mkdir()
    (ledger / "a.jsonl").write_text('{"item": "a", "status": "scored"}\n{"item": "b"')
    assert [r.item for r in records.ledger(spark, str(ledger)).collect()] == ["a"]
    (ledger / "a.jsonl").write_text('{"item": "a"}\n{"item"\n{"item": "c"}\n')
    with pytest.raises(Exception, match="corrupt ledger line"):
        records.ledger(spark, str(ledger)).collect()
    records.replace_file(str(tmp_path / "x.txt"), "new")
    assert (tmp_path / "x.txt").read_text() == "new" and not list(tmp_path.glob("*.tmp"))
    got = records.group_records(spark, spark.createDataFrame([("g", "kind: a\ngroup: 'b'\n---\nkind: c\n")], "path string, text string")).collect()
    assert sorted((r.document, r.name, r.value) for r in got) == [(0, "group", "b"), (0, "kind", "a"), (1, "kind", "c")]
    (tmp_path / "r.json").write_text('{"culls": [{"id": "a", "into": "b"}]}')
    assert records.build_records(spark, str(tmp_path / "r.json"), "culls array<struct<id: string, into: string>>").first().culls[0].into == "b"
    assert results.emitted("done", {"a": None, "b": [{"c": 1, "d": []}, "x"], "e": {"f": True}}) == 'a: null\nb:\n  - c: 1\n    d: []\n  - "x"\ne:\n  f: true\noutcome: done\n'
    assert [results.exit_code(x) for x in ("done", "bounded", "refused", "failed", "?")] == [0, 0, 1, 3, 0]
    assert results.rows_of(spark.range(3).orderBy("id"), 2) == ([{"id": 0}, {"id": 1}], "bounded")


def test_reading_order_is_the_depth_first_walk(spark):
    rng = random.Random(3)
    for _ in range(4):
        names = [f"d{i}" for i in range(9)]
        lists = {x: rng.sample(names[i + 1 :], min(len(names) - i - 1, rng.randrange(4))) for i, x in enumerate(names)}
        rows = [(p, i, c) for p, cs in lists.items() for i, c in enumerate(cs)]
        got = derive.reading_positions(spark.createDataFrame(rows or [("z", 0, "z")], "parent string, position int, child string"), "d0")
        assert [r.path for r in got.orderBy("position").collect()] == brute.reading_order(lists, "d0")
    loop = derive.reading_positions(spark.createDataFrame([("a", 0, "b"), ("b", 0, "a"), ("b", 1, "c"), ("a", 1, "c")], "parent string, position int, child string"), "a")
    assert [r.path for r in loop.orderBy("position").collect()] == ["a", "b", "c"]


def test_page_anchors_equal_the_slugger(spark):
    rng = random.Random(4)
    pages = {f"p{i}": [rng.choice(["A", "A 1", "A-1", "B", "b!", "A 1 1"]) for _ in range(12)] for i in range(8)}
    rows = [(p, i, h) for p, hs in pages.items() for i, h in enumerate(hs)]
    got = {(r.page, r.at): r.anchor for r in render.page_anchors(spark.createDataFrame(rows, "page string, at int, heading string")).collect()}
    for p, hs in pages.items():
        assert [got[p, i] for i in range(len(hs))] == T.slugs(["# " + h for h in hs])


def test_parts_hold_every_line_in_order(spark, tmp_path):
    rows = [(f"f{i % 3}", i, f"line {i}") for i in range(250)]
    got = render.parts(spark.createDataFrame(rows, "path string, n int, line string"), "path", [F.col("n")], F.col("line"), "text", 20)
    for f in ("f0", "f1", "f2"):
        assert "\n".join(r.text for r in got.where(F.col("path") == f).orderBy("part").collect()) == "\n".join(x for p, _, x in rows if p == f)
    render.write_files(got, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("path = 'f1'").count() == 83


def test_cut_words_and_alignment(spark):
    text = "lead\n# One\na **b** [c](d.md)\n## Two\n```\n# no\n```\n# Three\n"
    cut = documents.cut(text)
    assert [(s["n"], s["level"], s["title"], s["parent"]) for s in cut] == [(0, 0, "", None), (1, 1, "One", 0), (2, 2, "Two", 1), (3, 1, "Three", 0)]
    assert "\n".join(s["segment"] for s in cut) == text.rstrip("\n")
    assert documents.tokens(text) == ["lead", "One", "a", "b", "c", "Two", "#", "no", "Three"] and documents.cut("") == [{"n": 0, "level": 0, "title": "", "line": 1, "parent": None, "segment": ""}]
    docs = spark.createDataFrame([("x", text)], "path string, text string")
    assert documents.lost_words(docs, documents.sections(docs)).count() == 0
    runs = spark.createDataFrame([("x", ["a", "b"]), ("x", ["b", "a"]), ("x", [])], "path string, run array<string>")
    assert [r.run for r in documents.missed_runs(docs, runs).collect()] == [["b", "a"]]
    assert [r.n for r in documents.own_prose(documents.sections(docs)).collect()] == [1]


def test_stages_on_small_tables(spark):
    docs = spark.createDataFrame([("a.md", "# H\n\nOne long enough claim here. More of it.\n\nOne long enough claim here. Other.\n\n```math\nx <!-- node-id: clm-eeeeee -->\n```\n\n> **Lemma** b\n> c <!-- node-id: clm-bbbbbb -->\n")], "path string, text string")
    found = stages.discovered(p := stages.paragraphs(docs), p.select("path", "at", F.lit("A").alias("letter")))
    assert [r.title for r in found.orderBy("at").collect()][:2] == ["One long enough claim here.", "One long enough claim here. (¶3)"]
    assert found.where(~F.col("id").rlike(G.ID)).count() == 0
    text = docs.first().text
    assert [stages.visual_kind("T", text, i) for i in ("clm-eeeeee", "clm-bbbbbb", "clm-zzzzzz")] == ["equation", "block", "prose"]
    assert [stages.visual_kind(t, None, "x") for t in ("Equation (1)", "Lemma 2.1", "Other")] == ["equation", "block", "prose"]
    n, e, d = stages.seed(spark, "T")
    assert n.count() == e.count() == 0 and d.count() == 2
    gates = stages.conforms(verify.frontmatter(docs), verify.marker_faults(spark.createDataFrame([("clm-zzzzzz", "claim")], "id string, kind string"), docs))
    assert [(r.gate, r.detail) for r in gates.collect()] == [(2, "0")]
    spans = stages.contained(spark.createDataFrame([("a", 5, 9), ("a", 5, 400)], "path string, start int, stop int"), spark.createDataFrame([("a", 1, 300), ("b", 1, 300)], "path string, start int, stop int"))
    assert [(r.inner.stop, r.outer.start) for r in spans.collect()] == [(9, 1)]


def test_asks(spark):
    assert asks.rendered("a {{ x }} b {{y}} {{x}}", {"x": "1", "y": "2"}) == "a 1 b 2 1"
    with pytest.raises(Refused) as e:
        asks.rendered("{{ x }}", {"z": "1"})
    assert e.value.items == ["no value for x", "no slot z"]
    assert asks.timestamp(dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone(dt.timedelta(hours=2)))) == "2024-01-02T01:04:05Z"
    got = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T05:04:05+02:00",), ("no",)], "t string").select(asks.started_at(F.col("t")).alias("s")).collect()
    assert got[0].s == got[1].s and got[2].s is None
    b, p = G.bearing_of(F.col("t"))
    rows = spark.createDataFrame([("0.5",), (" *pending* ",), ("2",), ("x",), ("NaN",)], "t string").select(b.alias("b"), p.alias("p")).collect()
    assert [tuple(r) for r in rows] == [(0.5, False), (None, True), (None, None), (None, None), (None, None)]
    replies = asks.judged(spark.range(4), lambda batch: pd.Series(["x" if i % 2 else None for i in batch["id"]]))
    assert sorted((r.id, r.reply) for r in replies.collect()) == [(0, None), (1, "x"), (2, None), (3, "x")]


def test_compensated_sums_over_blocks(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, rng.choice([1e16, -1e16, 1.0, 1e-3])) for i in range(600)]
    import math

    for r in build.compensated_sums(spark.createDataFrame(rows, "k int, i long, v double"), "k", "i", "v", 50).collect():
        assert r.total == pytest.approx(math.fsum(v for k, _, v in rows if k == r.k), abs=8) and r.n == 200


def state(spark):
    docs = [("a.md", "# A\n\nFirst. <!-- node-id: clm-aaaaaa -->\n"), ("b.md", "See [first](a.md \"clm-aaaaaa\") and clm-bbbbbb here.\n\nSecond.\n"), ("axioms.md", "# Axioms\n")]
    nodes = [("claim", "clm-aaaaaa", "First", None, 0.5, False, "a.md"), ("claim", "clm-bbbbbb", "Second", None, 0.5, False, "b.md"), ("work", "wrk-aaaaaa", "Book", "B", None, None, None)]
    n = spark.createDataFrame(nodes, "kind string, id string, title string, label string, rigor double, manually_scored boolean, host string")
    e = spark.createDataFrame([("supports", None, "clm-aaaaaa", "clm-bbbbbb", "", 1.0, False, False)], "relation string, replaced_relation string, source string, target string, context string, bearing double, bearing_pending boolean, manually_scored boolean")
    return write.State(n, e, spark.createDataFrame(docs, "path string, text string"))


def test_writes_change_documents(spark, tmp_path):
    s = state(spark)
    text = lambda t, p: t.docs.where(F.col("path") == p).first().text
    with pytest.raises(Refused, match="b.md:1"):
        write.batch(s, [{"op": "remove-node", "id": "clm-aaaaaa"}])
    t = write.batch(s, [{"op": "edit-claim", "id": "clm-aaaaaa", "new_id": "clm-cccccc", "rigor": 0.25}])
    assert '"clm-cccccc"' in text(t, "b.md") and "node-id: clm-cccccc" in text(t, "a.md") and t.edges.first().source == "clm-cccccc"
    assert t.nodes.where("id = 'clm-cccccc'").first().manually_scored is True
    t = write.batch(s, [{"op": "move-node", "id": "clm-aaaaaa", "document": "b.md", "line": 3}])
    assert "clm-aaaaaa" not in text(t, "a.md") and text(t, "b.md").count("clm-aaaaaa") == 2 and "](b.md " in text(t, "b.md")
    t = write.batch(s, [{"op": "cite-bare-ids", "document": "b.md"}, {"op": "add-citation", "id": "clm-bbbbbb", "document": "a.md", "line": 3, "snippet": "First"}])
    assert '[Second](b.md "clm-bbbbbb")' in text(t, "b.md") and '[First](b.md "clm-bbbbbb")' in text(t, "a.md")
    t = write.batch(s, [{"op": "split-claim", "id": "clm-bbbbbb", "new_id": "ana-aaaaaa", "title": "How", "document": "b.md", "line": 3}, {"op": "add-axiom", "id": "axm-aaaaaa", "label": "S1", "title": "Rule"}])
    assert t.edges.where("relation = 'lifts'").count() == 1 and "## S1 Rule <!-- node-id: axm-aaaaaa -->" in text(t, "axioms.md") and t.nodes.where("id = 'ana-aaaaaa'").first().host == "b.md"
    gone = write.batch(s, [{"op": "edit-claim", "id": "clm-bbbbbb", "title": "S"}, {"op": "add-build-edges", "edges": [{"relation": "founds", "source": "wrk-aaaaaa", "target": "clm-bbbbbb"}]}])
    assert gone.edges.where("relation = 'founds'").first().bearing_pending is True
    faults = write.value_faults([{"op": "add-edge", "relation": "supports", "source": "x", "bearing": 2}, {"op": "?"}, {"op": "move-node", "id": "clm-aaaaaa", "line": 0, "odd": 1}])
    assert len(faults) == 6
    with pytest.raises(Refused):
        write.batch(s, [{"op": "?"}])


def test_commits_are_claimed_once(spark, tmp_path):
    folder, s = str(tmp_path / "kb"), state(spark)
    assert write.version(spark, folder) == 0 and write.commit(s, folder, 0) == 1
    held, at = write.checkout(spark, folder)
    assert at == 1 and held.docs.count() == 3
    changed = write.batch(held, [{"op": "edit-claim", "id": "clm-aaaaaa", "title": "New"}])
    assert write.commit(changed, folder, at) == 2
    with pytest.raises(write.Contention):
        write.commit(held, folder, at)
    assert write.checkout(spark, folder)[0].nodes.where("title = 'New'").count() == 1
    assert write.checkout(spark, folder, 1)[0].nodes.where("title = 'New'").count() == 0


def test_markers_hold_longer_ids_whole(spark):
    text = "# A\n\nOne. It is 1. <!-- node-id: clm-p100000 -->\n\nTwo. It is 2. <!-- node-id: clm-p100001, clm-p10000 -->"
    assert [i for i, _, _ in T.markers(text)] == ["clm-p100000", "clm-p100001", "clm-p10000"]
    docs = spark.createDataFrame([("a.md", text)], "path string, text string")
    first = derive.first_markers(T.markers_of(docs))
    assert {(r.id, r.line) for r in first.collect()} == {("clm-p100000", 3), ("clm-p100001", 5), ("clm-p10000", 5)}
    assert {(r.id, r.title) for r in stages.splits(docs).collect()} >= {("clm-p100000", "One."), ("clm-p100001", "Two.")}


def test_markers_take_a_prefix():
    text = "A <!-- other-id: clm-aaaaaa -->"
    assert T.markers(text) == [] and [i for i, *_ in T.markers(text, "other-id")] == ["clm-aaaaaa"]
    assert M.add_marker("a  \nb", 1, "clm-aaaaaa", "z-id") == "a <!-- z-id: clm-aaaaaa -->  \nb"
    once = M.add_marker("a", 1, "clm-aaaaaa")
    assert M.add_marker(once, 1, "clm-aaaaaa") == once and M.drop_marker(once, "clm-aaaaaa") == "a"
