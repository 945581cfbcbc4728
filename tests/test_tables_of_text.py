"""Operators over whole tables of text and ids: minting, shortlists, enclosing blocks, excerpts, edits, renames; text functions on hostile texts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.operators import asks, documents, edits, enclosing, ids, migrate, outline, rename, search

N = 1_000_000
HOSTILE = {
    "open comments": "<!--" * (N // 4), "open markers": "<!-- node-id:" * (N // 13), "commas": "Lemma 1" + " ," * (N // 2), "mentions": "Lemma 1 , " * (N // 10), "links": "[x](clm-abcdef) clm-abcdef " * (N // 27),
    "one paragraph": "".join(f"clm word <!-- node-id: clm-{i:06d} -->\n" for i in range(N // 40)), "spaces": "<!-- node-id: x" + " " * N, "ids": "clm-abcdef " * (N // 11),
}


@pytest.mark.parametrize("shape", HOSTILE)
def test_text_functions_are_linear(shape):
    text = HOSTILE[shape]
    for fn in (T.words, T.markers, T.bare_ids, M.mentions, M.statements, documents.tokens, T.without_markers, lambda x: M.drop_marker(x, "clm-000001"), lambda x: migrate.moved_markers(x, set(), "node-id", "id")):
        began = time.process_time()
        fn(text)
        assert time.process_time() - began < 3


def test_mentions_and_their_ranges():
    found = {
        "Lemmas 2.1, 2.3 and 4": [("lemma", "2.1", None), ("lemma", "2.3", None), ("lemma", "4", None)], "Theorems 1-3 and 5 to 7, 9": [("theorem", "1", "3"), ("theorem", "5", "7"), ("theorem", "9", None)],
        "Lemma 1 - to 3": [("lemma", "1", None), ("lemma", "3", None)], "Lemma 1-9999999999": [("lemma", "1", "9999999999")], "Corollaries 1.2–1.5-1.7": [("corollary", "1.2", "1.5"), ("corollary", "1.7", None)],
        "Lemma 3-1": [("lemma", "3", None), ("lemma", "1", None)], "claim x, Lemma": [], "Lemma 1" + " , " * 40 + "x": [("lemma", "1", None)],
    }
    assert {x: M.mentions(x) for x in found} == found


def test_unclosed_comments_keep_their_words():
    assert documents.tokens("a <!-- b --> c <!-- d") == ["a", "c", "<!--", "d"]
    assert [w for _, _, w in T.words("a <!-- b --> c <!-- d\n--> e <b <!-- x --> y>")] == ["a", "c", "d", "e", "b", "y"]
    assert T.markers("<!-- node-id: clm-aaaaaa --> <!-- node-id: clm-bbbbbb") == [("clm-aaaaaa", 0, 0)]
    assert M.statements("One <!-- node-id: clm-aaaaaa -->\ntwo <!-- node-id: clm-bbbbbb -->\n\nthree <!-- node-id: clm-cccccc -->") == {"clm-aaaaaa": "One \ntwo", "clm-bbbbbb": "One \ntwo", "clm-cccccc": "three"}


def serially(seeds, prefix, reserved, digits):
    """One pass in ascending order, over Python integers."""
    import hashlib

    def body(seed, n):
        v = int.from_bytes(hashlib.sha256((seed + (f"\0{n}" if n else "")).encode()).digest()[:8], "big")
        out = ""
        for _ in range(digits):
            out, v = out + ids.ALPHABET[v % 36], v // 36
        return f"{prefix}-{out}"

    taken, out = set(reserved), {}
    for seed in sorted(set(seeds)):
        n = 0
        while body(seed, n) in taken:
            n += 1
        out[seed] = body(seed, n)
        taken.add(out[seed])
    return out


def test_minting_equals_one_pass(spark):
    rng = random.Random(21)
    seeds = [f"s{rng.randrange(900)}" for _ in range(700)] + ["é", ""]  # about two fifths of all ids
    reserved = sorted(serially([f"s{i}" for i in range(40)], "clm", [], 2).values()) + [None]
    table = spark.createDataFrame([(s,) for s in [*seeds, None]], "seed string")
    got = {r.seed: r.id for r in ids.mint(table, "clm", spark.createDataFrame([(x,) for x in reserved], "id string"), 2).collect()}
    assert got == serially(seeds, "clm", reserved[:-1], 2) and len(set(got.values())) == len(got)
    assert ids.mint(table.limit(0), "clm").count() == 0
    with pytest.raises(ValueError):
        ids.mint(table, "clm", digits=1)


def test_minting_a_million_seeds_without_a_repeat(spark):
    got = ids.mint(spark.range(10**6).select(F.col("id").cast("string").alias("seed")), "clm")
    assert tuple(got.agg(F.count_distinct("id"), F.count_distinct("seed"), F.count(F.lit(1))).first()) == (10**6,) * 3


def enclosed(points, spans):
    out, n = [], {}
    real = sorted({s for s in spans if s[1] < s[2]}, key=lambda s: (s[1], -s[2], s[3]))
    for path, line, name in sorted(points, key=lambda p: (p[0], p[1], p[2])):
        held = [s for s in real if s[0] == path and s[1] <= line < s[2]]
        host = held[-1][3] if held else None
        n[path, host] = n.get((path, host), 0) + 1
        out.append((path, line, name, host, len(held), n[path, host]))
    return out


def test_innermost_spans_hold_places_in_order(spark):
    rng, spans = random.Random(41), []

    def nest(path, a, b, depth):
        spans.append((path, a, b, f"{path}{len(spans):04d}"))
        while depth and b - a > 2:
            a = rng.randrange(a, b)
            stop = rng.randrange(a, b) + 1
            nest(path, a, stop, depth - 1)
            a = stop

    for path in "abc":
        for i in range(4):
            nest(path, 100 * i, 100 * i + 90, 4)
    spans += [("a", 5, 5, "empty"), ("a", 300, 390, "zz"), ("b", 7, 3, "back")]
    points = [(rng.choice("abcd"), rng.randrange(-5, 420), f"n{i}") for i in range(600)]
    table = spark.createDataFrame(points, "path string, line long, id string")
    held = spark.createDataFrame(spans, "path string, start long, stop long, id string")
    got = enclosing.innermost(table, held.unionByName(held.limit(5)))
    assert got.columns == ["path", "line", "id", "host", "depth", "at"]
    want = enclosed([(p, n, f'{{"path":"{p}","line":{n},"id":"{i}"}}') for p, n, i in points], spans)
    assert sorted((r.path, r.line, r.host or "", r.depth, r["at"]) for r in got.collect()) == sorted((p, n, h or "", d, a) for p, n, _, h, d, a in want)
    assert enclosing.innermost(table, held.limit(0)).where("host is null and depth = 0").count() == 600
    assert enclosing.innermost(table.limit(0), held).count() == 0
    assert [(r.id, r.start, r.stop) for r in enclosing.crossing(spark.createDataFrame([("a", 1, 5, "x"), ("a", 3, 8, "y"), ("a", 10, 12, "z")], "path string, start long, stop long, id string")).orderBy("id").collect()] == [("x", 1, 5), ("y", 3, 8)]
    with pytest.raises(ValueError):
        enclosing.innermost(table, spark.createDataFrame([("a", 1, 5, "x"), ("a", 3, 8, "y")], "path string, start long, stop long, id string"))


def test_excerpts_are_found_wherever_they_begin(spark):
    rng = random.Random(51)
    vocabulary = ["Compact", "operators,", "have", "a", "norm.", "The", "bound*", "is", "sharp", "[here](x.md)", "é", "aa", "aaa"]
    docs = [(f"d{i}", "\n".join(rng.choice(["", "> "]) + " ".join(rng.choices(vocabulary, k=rng.randrange(7))) for _ in range(rng.randrange(9)))) for i in range(40)] + [("none", None), ("a", "a a a a\na a")]
    excerpts = [(i, x) for i, x in enumerate(["a a", "operators, have", "OPERATORS have", "perators have a no", "bound is", "here", "aa", "", " \n", None, "sharp\n  a", "not there", "x" * 50, "norm. The"])] + [(0, "a a"), (99, "a a")]
    excerpts += [(100 + i, " ".join(rng.choices(vocabulary, k=3)).swapcase()) for i in range(60)]
    want = sorted({(i, p, line) for i, x in excerpts if x for p, t in docs for line in T.excerpt_lines(t or "", x)})
    e, d = spark.createDataFrame(excerpts, "id long, text string"), spark.createDataFrame(docs, "path string, text string")
    for block in (4_000_000, 90):
        got = [tuple(r) for r in search.search(e, d, block=block).collect()]
        assert sorted(set(got)) == want
    assert search.search(e.limit(0), d).count() == 0 and search.search(e, d.limit(0)).count() == 0


def test_excerpt_search_is_linear():
    found = search.Searcher([f"word{i} and more" for i in range(20_000)] + ["a " * 50], True)
    began = time.process_time()
    assert sum(1 for _ in found.lines("a " * 100_000 + "\nword7  and MORE")) > 99_000
    assert time.process_time() - began < 5


def plainly(text, script):
    """The script over a list of characters: each taken edit owns what it removes and the gaps inside."""
    owner, gaps, taken, refused = [None] * len(text), set(), [], []
    for e in sorted(set(script)):
        _, a, b, _ = e
        inner = any(owner[a - 1] is not None and owner[a - 1] == owner[a] for _ in (0,)) if 0 < a < len(text) else False
        if not 0 <= a <= b <= len(text) or any(owner[a:b]) or (a == b and inner) or (a < b and any(a < g < b for g in gaps)):
            refused.append(e)
            continue
        taken.append(e)
        if a == b:
            gaps.add(a)
        owner[a:b] = [len(taken)] * (b - a)
    out = []
    for i in range(len(text) + 1):
        out += [e[3] for e in taken if e[1] == e[2] == i]
        out += [e[3] for e in taken if e[1] == i < e[2]]
        out.append(text[i] if i < len(text) and owner[i] is None else "")
    return "".join(out), refused


def test_scripts_apply_by_rank_and_refuse_overlaps(spark):
    rng = random.Random(61)
    for _ in range(400):
        text = "".join(rng.choices("abc\né日", k=rng.randrange(12)))
        script = [(rng.randrange(3), a := rng.randrange(-1, 13), a + rng.choice([0, 0, 1, 2, 4, -1]), rng.choice(["", "X", "YZ"])) for _ in range(rng.randrange(9))]
        got, refused = edits.apply_script(text, script)
        want, lost = plainly(text, script)
        assert (got, refused) == (want, lost)
    docs = spark.createDataFrame([("a", "one two", 1), ("b", None, 2), ("c", "kept", 3)], "path string, text string, refusal int")
    script = spark.createDataFrame([("a", 0, 3, 7, ""), ("a", 1, 5, 6, "x"), ("a", 0, 0, 0, "> "), ("b", 0, 0, 0, "new"), ("d", 0, 0, 0, "lost")], "path string, rank int, start int, stop int, text string")
    done = {r.path: (r.text, len(r.refused), r.refusal) for r in edits.apply_edits(docs, script).collect()}
    assert done == {"a": ("> one", 1, 1), "b": ("new", 0, 2), "c": ("kept", 0, 3)}


def test_each_node_gets_one_marker(spark):
    mark = lambda *ids: f"<!-- node-id: {', '.join(ids)} -->"
    a, b, c, d, e, q, w, z = (f"clm-{x * 6}" for x in "abcdeqwz")
    texts = {
        "1.md": f"# One\n\nText. {mark(a, b)} {mark(z)}\n{mark(a)}\nMore. {mark('ana-aaaaaa')}\n",
        "2.md": f"Intro\n# Two ##  \n> **Lemma**\n>\n> Claimed. {mark(b)}\n\n```math\nx \\label{{eq:q}}\ny\n```\n",
        "3.md": f"No heading {mark(c)} {mark('ana-aaaaaa')}", "4.md": "# Four\n> **Lemma**\n> It holds.\nend",
    }
    claims = [(a, "A"), (b, "B"), (c, "C"), (d, "D"), (e, "E"), (q, "Equation (`eq:q`) — so"), (w, "W")]
    listing = [("1.md", a), ("2.md", a), ("2.md", b), ("4.md", d), ("3.md", e), ("2.md", q), ("9.md", w), ("1.md", z)]
    hosted = [("ana-aaaaaa", "4.md", 1), ("exp-aaaaaa", "2.md", 5), ("exp-bbbbbb", "2.md", 2), ("exp-cccccc", "3.md", 1)]
    docs = spark.createDataFrame(sorted(texts.items()), "path string, text string")
    script, warnings, found = edits.placed_markers(docs, spark.createDataFrame(claims, "id string, title string"), spark.createDataFrame(listing, "path string, id string"), spark.createDataFrame(hosted, "id string, path string, line int"))
    got = {r.path: r.text for r in edits.apply_edits(docs, script).collect()}
    assert got == {
        "1.md": f"# One\n\nText. {mark(a)}\nMore. {mark('ana-aaaaaa')}\n",
        "2.md": f"Intro\n# Two ##  \n{mark('exp-bbbbbb')}\n{mark('exp-aaaaaa')}\n> **Lemma**\n>\n> Claimed. {mark(b)}\n\n```math\nx \\label{{eq:q}} {mark(q)}\ny\n```\n",
        "3.md": f"No heading {mark(c)}", "4.md": f"# Four\n> **Lemma**\n> It holds. {mark(d)}\nend",
    }
    assert sorted(tuple(r) for r in warnings.collect()) == [("3.md", e, "no heading to carry it"), ("3.md", "exp-cccccc", "no heading to place it after")]
    assert sorted(tuple(r) for r in found.mentions.collect()) == [("2.md", a, "1.md")]
    assert found.drops.where("why = 'names no node'").count() == 1


def test_renames_follow_tokens_in_place(spark):
    text = 'See wrk-smith.2020. and clm-aaaaaa, not xclm-aaaaaa or clm-aaaaaab.\r\n[clm-aaaaaa](p.md#clm-aaaaaa "clm-aaaaaa") `clm-aaaaaa` <!-- node-id: clm-aaaaaa -->\n```\nclm-aaaaaa\n```\n[x]: clm-aaaaaa\nclm-bbbbbb é clm-aaaaaa'
    names = spark.createDataFrame([("clm-aaaaaa", "clm-bbbbbb"), ("clm-bbbbbb", "clm-cccccc"), ("wrk-smith.2020", "wrk-q1w2e3"), ("clm-aaaaaa", "clm-zzzzzz"), (None, "x"), ("clm-dddddd", None)], "old string, new string")
    docs = spark.createDataFrame([("a", text, 1), ("b", None, 2), ("c", "clm-dddddd", 3)], "path string, text string, old int")
    bare = {r.path: (r.text, r.old) for r in rename.renamed(docs, names).collect()}
    whole = 'See wrk-q1w2e3. and clm-bbbbbb, not xclm-aaaaaa or clm-aaaaaab.\r\n[clm-bbbbbb](p.md#{0} "{0}") `clm-aaaaaa` <!-- node-id: {0} -->\n```\nclm-aaaaaa\n```\n[x]: {0}\nclm-cccccc é clm-bbbbbb'
    assert bare == {"a": (whole.format("clm-aaaaaa"), 1), "b": ("", 2), "c": ("clm-dddddd", 3)}
    assert rename.renamed(docs, names, scope="all").where("path = 'a'").first().text == whole.format("clm-bbbbbb")
    records = spark.createDataFrame([("clm-aaaaaa", "wrk-smith.2020", "_old"), ("clm-x", None, "k")], "source string, target string, new string")
    assert sorted(map(str, rename.renamed_ids(records, names, "source", "target").collect())) == ["Row(source='clm-bbbbbb', target='wrk-q1w2e3', new='_old')", "Row(source='clm-x', target=None, new='k')"]


def test_a_hundred_thousand_renames_in_one_job(spark):
    n = 100_000
    docs = spark.range(2000).select(F.col("id").cast("string").alias("path"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda j: F.concat(F.lit("clm-"), F.lpad((F.col("id") * 50 + j).cast("string"), 6, "0"))), " and ").alias("text"))
    names = spark.range(n).select(F.concat(F.lit("clm-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("old"), F.concat(F.lit("clm-z"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("new"))
    got = rename.renamed(docs, names).select(F.explode(F.split("text", " and ")).alias("t"))
    assert tuple(got.agg(F.count(F.lit(1)), F.count_distinct("t"), F.count_if(F.col("t").startswith("clm-z"))).first()) == (n, n, n)


def test_quoted_texts_read_back_from_one_line(spark):
    from argosy.operators.render import quoted
    from argosy.sources.records import scalar

    texts = ["", "plain", 'a "b" \\ c', "two\nlines\r\nand\ttabs", "".join(map(chr, range(1, 33))), "\x7f\x85\u2028\u2029 é 日 😀", "# no comment", "*pending*", "/", None]
    got = [(r.t, r.q) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", quoted(F.col("t")).alias("q")).collect()]
    assert [(t, q if q is None else scalar(q)) for t, q in got] == [(t, None if t is None else ("s", t)) for t in texts]
    assert all(q is None or len(q.splitlines()) == 1 for _, q in got)


def test_a_broken_run_asks_nothing_twice(spark, tmp_path):
    calls, broken, folder = tmp_path / "calls", tmp_path / "broken", str(tmp_path / "replies")
    calls.mkdir()
    broken.touch()

    def judge(batch):
        import uuid

        out = []
        for digest in batch["digest"]:
            if broken.exists() and digest == "d7":
                raise RuntimeError("the judge broke off")
            (calls / f"{digest}-{uuid.uuid4().hex}").touch()
            out.append(None if digest == "d9" else f"reply to {digest}")
        return out

    rows = spark.createDataFrame([(i, f"d{i % 40}") for i in range(100)], "item int, digest string")
    with pytest.raises(Exception, match="broke off"):
        asks.answered(rows, judge, folder, waves=8).collect()
    kept = {r.digest for r in spark.read.parquet(folder).collect()}
    before = {p.name for p in calls.iterdir()}
    assert kept and "d7" not in kept
    broken.unlink()
    got = asks.answered(rows, judge, folder, waves=8).collect()
    assert len(got) == 100 and all(r.reply == (None if r.digest == "d9" else f"reply to {r.digest}") for r in got)
    again = [p.name.partition("-")[0] for p in calls.iterdir() if p.name not in before]
    assert not kept & set(again) and len(again) == len(set(again))
    assert {r.reply is None for r in asks.answered(rows, judge, folder).collect() if r.digest == "d9"} == {True}
    last = [p.name.partition("-")[0] for p in calls.iterdir()]
    assert len(last) - len(before) - len(again) == 1  # the failed one alone


def walked(children, files, entry):
    """The walk by recursion: documents (path, volume, rank, number, first, last, label) and findings."""
    lists, out, findings, seen, labels = {}, [], [], set(), {}
    for parent, position, child in sorted(children):
        lists.setdefault(parent, []).append(child)

    def visit(path, volume, top, rank, number):
        import re

        seen.add(path)
        row = [path, volume, rank, number, len(out), 0, ""]
        out.append(row)
        below = re.sub(r"\.[^./]*$", "", path[len(top) + 1 :]).lower()
        label = f"vol{volume}" if not rank else f"d{volume}-" + re.sub(r"[\W_]+", "-", below).strip("-")
        if label in labels:
            findings.append(("label again", path, label))
        else:
            labels[label], row[6] = path, label
        n = 0
        for child in lists.get(path, []) if path.endswith("index.md") else []:
            if child.endswith("references.md"):
                continue
            if not child.startswith(top + "/"):
                findings.append(("outside its volume", path, child))
            elif child not in files:
                findings.append(("no such document", path, child))
            elif child in seen:
                findings.append(("walked already", path, child))
            else:
                n += 1
                visit(child, volume, top, rank + 1, f"{number}.{n}")
        row[5] = len(out) - 1

    volume, named = 0, set()
    for child in lists.get(entry, []):
        if child.rpartition("/")[2] != "index.md":
            continue
        if child in named:
            findings.append(("volume again", entry, child))
        elif child not in files:
            findings.append(("no such volume", entry, child))
            named.add(child)
        else:
            volume += 1
            named.add(child)
            visit(child, volume, child.rpartition("/")[0], 0, str(volume))
    return sorted(map(tuple, out)), sorted(findings)


def test_walks_of_trees_with_cycles_and_clashing_labels(spark):
    rng = random.Random(71)
    indexes = {v: [f"{v}/index.md"] + [f"{v}/{d}/index.md" for d in "pq"] for v in "abc"}
    leaves = {v: [f"{v}/{d}{n}.md" for d in ("", "p/", "q/") for n in ("One", "one", "two x", "two-x", "references")] for v in "abc"}
    children = [("kb.md", i, f"{v}/index.md") for i, v in enumerate("abca")] + [("kb.md", 9, "x/index.md"), ("kb.md", 7, "a/one.md")]
    for v in "abc":
        for path in indexes[v]:
            pool = indexes[v][1:] + leaves[v] + ["b/one.md", f"{v}/gone.md", indexes[v][0]]
            children += [(path, i, c) for i, c in enumerate(rng.sample(pool, 9))]
    files = [p for v in "abc" for p in indexes[v] + leaves[v]] + ["kb.md"]
    kids = spark.createDataFrame(children, "parent string, position int, child string")
    there = spark.createDataFrame([(f,) for f in files], "path string")
    found = outline.walk(kids, there, "kb.md")
    documents, findings = walked(children, set(files), "kb.md")
    assert sorted(tuple(r) for r in found.documents.collect()) == documents
    assert sorted(tuple(r) for r in found.findings.collect()) == findings
    assert outline.walk(kids.limit(0), there, "kb.md").documents.count() == 0
    with pytest.raises(ValueError):
        outline.walk(kids.unionByName(spark.createDataFrame([("kb.md", 4, "a/p/index.md")], kids.schema)), there, "kb.md")
