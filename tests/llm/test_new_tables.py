"""Conversation repair, decontamination and clustering against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from argosy.llm import centroids, decontaminate, queries, repair

from .helpers import ODD, docs, words
from .test_tables import same

TURNS = "conv_id long, turn long, role string, text string, _row string, cost string, audit int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], TURNS)


def faults(rows):
    """(role, text, fault) of one conversation's rows (turn, role, text) in order."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())):
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """Uniform-cost search over (rows done, roles so far's last initial): least cost, then least audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, kept
        if (i, last) in done:
            continue
        done.add((i, last))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in may:
                heapq.heappush(heap, (cost + 3, audit + "I", i, r, (*kept, f"{name}:")))
        if i < len(rows):
            _, role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, kept))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if role[:1] and role[:1] in may:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*kept, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in may:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, r, (*kept, f"{name}:{text}")))
    raise AssertionError


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        found = faults(own)
        cost, audit, kept = cheapest(found)
        held = [t for t, *_ in found if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(found)]
        out[conv] = (max(held) - min(held) + 1 - len(set(held)) if held else 0, *[sum(f == k for *_, f in found) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, list(kept))
    return out


def check(spark, rows):
    got = repair.repair(turns(spark, rows))
    lines = {}
    for r in got.turns.collect():
        lines.setdefault(r.conv_id, []).append((r["at"], f"{r.role}:{r.text}"))
    hashes = {r.conv_id: r.sha256 for r in repair.digests(got.turns).collect()}
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [x for _, x in sorted(lines.get(r.conv_id, []))]) for r in got.conversations.collect()}
    assert found == expected(rows)
    for conv, own in found.items():
        if own[-1]:
            assert hashes[conv] == hashlib.sha256("\n".join(own[-1]).encode()).hexdigest()


def test_repair_matches_a_search(spark):
    rng = random.Random(11)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(["Yes.", "No", "", " \n", "Why?", f"Own {rng.random()}.", None])) for c in range(60) for _ in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello!"), (70, 3, "user", "Same."), (70, 3, "user", "Same."), (71, None, None, None)]
    check(spark, rows)
    assert repair.repair(turns(spark, []).limit(0)).conversations.count() == 0


def test_repair_of_a_conversation_across_partitions(spark):
    rng = random.Random(12)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Turn {t}.", f"open {t}", "Again.", ""])) for t in range(1500)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"{c} {t}!") for c in (1, 9) for t in range(5)]
    check(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")  # two levels of the tree
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repair_of_one_row_repeated(spark):
    rows = [(1, 1, "user", "The same."), (1, 2, "assistant", "Fine.")] * 400
    check(spark, rows)


def test_min_plus_product_is_associative():
    rng = random.Random(13)
    for _ in range(50):
        a, b, c = (repair.product(bytes(rng.choices(range(12), k=rng.randrange(1, 5)))) for _ in range(3))
        assert repair.times(repair.times(a, b), c) == repair.times(a, repair.times(b, c))
    codes = bytes(rng.choices(range(12), k=100))
    assert repair.product(codes) == repair.times(repair.product(codes[:37]), repair.product(codes[37:]))


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(5)] + [(None, None, None, None)]
    want = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        want += {0: [], 1: [(conv, turn, role, "")], 2: [(conv, turn, role, re.sub("[.!?]", "", text))], 3: [(conv, turn, role, text)] * 2, 4: [(conv, turn, "user", text)]}.get(fate, [(conv, turn, role, text)])
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in repair.damaged(turns(spark, rows)).collect())


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination(rows, items, window=10, share=1.0):
    out = []
    for i, text, *_ in rows:
        w, hit, own = lowered(text), set(), set()
        for item, t in items:
            b = lowered(t)
            for at in range(max(len(b) - window, 0) + 1) if b else ():
                win = b[at : at + window]
                size = min(5, len(win))
                grams = [win[j : j + size] for j in range(len(win) - size + 1)]
                for s in range(len(w) - len(win) + 1):
                    if sum(w[s + j : s + j + size] == g for j, g in enumerate(grams)) >= -(-share * len(grams) // 1):
                        hit |= set(range(s, s + len(win)))
                        own.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_decontamination_matches_brute_force(spark, share):
    rng = random.Random(14)
    items = [(i, words(n, i, 40)) for i, n in enumerate([0, 1, 3, 9, 10, 11, 30, 30, 5])] + [(6, words(14, 99)), (None, words(12, 98)), (20, None), (21, "a b a b a b a b a b a b"), (22, words(12, 98))]
    held = [t for _, t in items if t]
    rows = [(i, " ".join(rng.choice([words(rng.randrange(20), rng.random(), 40), rng.choice(held).upper(), " ".join(rng.choice(held).split()[:9]), "ÉÉ, a;b a-b"]) for _ in range(4))) for i in range(40)] + ODD + [(90, "a b " * 20), (90, held[5])]
    got = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("_key", F.lit(1)).withColumn("doc_id", F.lit(1)), share=share).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), r["items"]) for r in got), key=repr) == contamination(rows, items, share=share)
    assert all(r.contaminated == bool(r.spans) for r in got)


def test_decontamination_of_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.doc_id, r.contaminated) for r in decontaminate.decontaminate(docs(spark, ODD[:3]), none).orderBy("doc_id").collect()] == [(1, False), (2, False), (3, False)]
    assert decontaminate.decontaminate(docs(spark, ODD).limit(0), none).count() == 0
    passage = words(10, 3)
    long = docs(spark, [(1, words(200_000, 7) + " " + passage), (2, "clean")] + [(3 + i, passage) for i in range(500)])
    item = spark.createDataFrame([(4, passage)], "item_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.decontaminate(long, item).collect()}
    assert got[1] == [(200_000, 200_010)] and got[2] == [] and all(got[3 + i] == [(0, 10)] for i in range(500))
    assert [r.doc_id for r in decontaminate.drop_contaminated(long, item).collect()] == [2]


def plain_clusters(vectors, k, rounds, seed, scale=256):
    """Lloyd's rounds over Python integers."""
    import math

    v = [(i, [math.floor(float(x) * scale) for x in e], e) for i, e in vectors]
    rank = lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), [float(x) for x in r[2]])
    c = [list(r[1]) for r in sorted(v, key=rank)[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        own = [min(range(len(c)), key=lambda j: (d2(x, c[j]), j)) for _, x, _ in v]
        for j in range(len(c)):
            rows = [x for o, (_, x, _) in zip(own, v, strict=True) if o == j]
            if rows:
                c[j] = [sum(col) // len(rows) for col in zip(*rows, strict=True)]
    own = [min(range(len(c)), key=lambda j: (d2(x, c[j]), j)) for _, x, _ in v]
    return sorted([(i, o, d2(x, c[o]), ",".join(map(str, c[o]))) for o, (i, x, _) in zip(own, v, strict=True)], key=repr)


def clustered(spark, vectors, k, rounds, dim):
    held = spark.createDataFrame([(i, e, "x", 1) for i, e in vectors], "vec_id long, embedding array<double>, _c string, cluster int").repartition(3)
    got = centroids.cluster(held, k, rounds, centroids.seeded_rank(2), dim=dim).collect()
    totals = {}
    for r in got:
        totals[r.cluster] = totals.get(r.cluster, 0) + r.distance
    most = 2**63 - 1
    assert all(r.cluster_inertia == min(totals[r.cluster], most) and r.inertia == min(sum(totals.values()), most) for r in got)
    return sorted([(r.vec_id, r.cluster, r.distance, r.centroid) for r in got], key=repr), sum(r.n_measured for r in got)


def test_clusters_match_plain_rounds(spark):
    rng = np.random.default_rng(15)
    at = rng.normal(size=(6, 8))
    vectors = [(i, (at[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(300)]
    got, measured = clustered(spark, vectors, 12, 5, 8)
    assert got == plain_clusters(vectors, 12, 5, 2)
    assert measured < 300 * 12 * 3  # bounds spare more than half of six rounds
    grid = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]  # ties and repeated vectors
    grid += [(7, grid[7][1]), (7, grid[8][1]), (None, [0.0] * 4), (None, [1.0] * 4)]
    assert clustered(spark, grid, 10, 4, 4)[0] == plain_clusters(grid, 10, 4, 2)


def test_clusters_take_odd_vectors(spark):
    odd = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, float("nan"), 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, None, 0.0])]
    assert clustered(spark, odd, 3, 2, 3)[0] == []
    few = [*odd, (7, [0.0, -0.0, 0.5]), (8, [0.001, -0.001, 0.0])]
    assert clustered(spark, few, 5, 2, 3)[0] == plain_clusters(few[-2:], 5, 2, 2)
    wide = [(i, [float(x) * 2**60, 1e-3 * x, -3.0]) for i, x in enumerate([1, 2, 3, 50, 51, 52])]
    most = 2**63 - 1
    assert clustered(spark, wide, 2, 3, 3)[0] == [(i, c, min(d, most), t) for i, c, d, t in plain_clusters(wide, 2, 3, 2)]


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_decontaminate", "op13_centroids"])
def test_new_oracles_on_odd_rows(spark, tmp_path, name):
    rng = random.Random(16)
    turns(spark, [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", "", None]), rng.choice(["Hi.", "Ho", "", None, f"{i}?"])) for i in range(120)]).write.parquet(str(tmp_path / "conversations.parquet"))
    docs(spark, [*ODD, (9, words(40, 3)), (9, words(40, 3).title())]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, words(40, 3)), (2, "word"), (None, "no id here"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    vector = lambda: [round(rng.gauss(0, 1), 1) for _ in range(64)]
    spark.createDataFrame([(i % 70, vector(), 1) for i in range(90)] + [(None, vector(), 1), (200, None, 1), (201, [1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.ORACLES[name]
    same(spark, name, str(tmp_path))
