"""Iterative operators on directed graphs: closure, levels, shortest paths, cycles, reduction, contraction.

Loops run on the driver, data stays distributed: each round is a join whose result is settled. Which shortcut is dropped depends on
the order of edges only inside a strongly connected part, so a kernel reduces each part in a task of its own, whatever its size, and
joins settle the edges between parts. Which edges of cycles are cut depends on the walk through a weakly connected part: a kernel cuts
parts of up to KERNEL_EDGES edges, each in a task, and larger ones lose one edge at a time by distributed rounds until they fit.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.functions.graph import SCORING, relation_rank
from argosy.operators.components import components
from argosy.operators.prefix import before
from argosy.plans.star import settle, stored

KERNEL_EDGES = 200_000


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, depth: everything reachable from each start over (source, target), at its least depth."""
    front = settle(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct())
    seen = front
    while front.limit(1).count():
        step = front.join(edges.select(F.col("source").alias("node"), F.col("target").alias("_next")), "node").select("start", F.col("_next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        front = settle(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = settle(seen.unionByName(front))
    return seen


def shortest_path(edges: DataFrame, source: str, target: str) -> list[str] | None:
    """A shortest path, successors in id order; the frontier stays distributed, one node per level comes back."""
    spark, levels = edges.sparkSession, []
    front = settle(spark.createDataFrame([(source,)], "id string"))
    seen = front
    while True:
        levels.append(front)
        if front.where(F.col("id") == target).limit(1).count():
            break
        step = edges.join(front.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        front = settle(step.join(seen, "id", "left_anti"))
        if not front.limit(1).count():
            return None
        seen = settle(seen.unionByName(front))
    path = [target]
    for level in reversed(levels[:-1]):
        before = edges.where(F.col("target") == path[0]).join(level.select(F.col("id").alias("source")), "source", "left_semi").agg(F.min("source")).first()[0]
        path.insert(0, before)
    return path


def levels(edges: DataFrame) -> DataFrame:
    """id, level: sources first; null for nodes on a cycle and for all that rests on one."""
    left = settle(edges.select("source", "target").distinct())
    nodes = settle(left.select(F.col("source").alias("id")).union(left.select("target")).distinct())
    out, level = None, 0
    while True:
        ready = settle(nodes.join(left.select(F.col("target").alias("id")), "id", "left_anti"))
        if not ready.limit(1).count():
            break
        placed = ready.withColumn("level", F.lit(level))
        out = placed if out is None else out.unionByName(placed)
        nodes = settle(nodes.join(ready, "id", "left_anti"))
        left = settle(left.join(ready.select(F.col("id").alias("source")), "source", "left_anti"))
        level += 1
    rest = nodes.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left after dropping, again and again, those into nodes without a way on. Ancestors of cycles stay: which edge closes first depends on them."""
    left = settle(edges)
    n = left.count()
    while n:
        left = settle(left.join(left.select(F.col("source").alias("_s")).distinct(), F.col("target") == F.col("_s"), "left_semi"))
        n, before = left.count(), n
        if n == before:
            break
    return left


def cuts_by_start(edges: list[tuple[str, str, str]], rank: dict[str, int], kinds: dict[str, str]) -> list[tuple[str, tuple[str, str, str]]]:
    """The node that the walk starts from and the edge of every cut, without walking anew: each node that reaches a cycle leads on by its first edge to another such node, so the first cycle closes on the path of first edges from the first node. Nodes go by rank, then by id, shorter ids first, so that ids that grow with their number keep its order."""
    order = {r: i for i, r in enumerate(SCORING)}
    place = lambda x: (rank.get(x, len(rank)), len(x), x)
    ranked = sorted(set(edges), key=lambda e: (order[e[0]], place(e[1]), place(e[2])))
    at, ways, into = {e: i for i, e in enumerate(ranked)}, defaultdict(list), defaultdict(list)
    for e in ranked:
        ways[e[1]].append(e)
        into[e[2]].append(e)
    nodes = sorted({x for _, a, b in ranked for x in (a, b)}, key=place)
    gone, left, first = set(), {x: len(ways[x]) for x in nodes}, dict.fromkeys(nodes, 0)

    def drop(e):
        ends = [e]
        while ends:
            e = ends.pop()
            if e not in gone:
                gone.add(e)
                left[e[1]] -= 1
                if not left[e[1]]:
                    ends += into[e[1]]

    for x in nodes:
        if not ways[x]:
            for e in into[x]:
                drop(e)
    cuts = []
    for start in nodes:
        while left[start]:
            trail, on, x = [], {}, start
            while x not in on:
                on[x] = len(trail)
                while ways[x][first[x]] in gone:
                    first[x] += 1
                trail.append(ways[x][first[x]])
                x = trail[-1][2]
            cuts.append((start, _cut_of(trail[on[x] :], kinds, at.__getitem__)))
            drop(cuts[-1][1])
    return cuts


def _cut_of(closing: list[tuple[str, str, str]], kinds: dict[str, str], place) -> tuple[str, str, str]:
    into = [e for e in closing if e[0] == "supports" and kinds.get(e[2]) == "analysis"]
    return min(into, key=place) if into else closing[-1]


def _next_cut(core: DataFrame) -> tuple[str, tuple[str, str, str]]:
    """The walk's start and first cut in a core (of `placed`) that stays distributed: each node's first edge, the nodes on the path of these by doubling, and only that path on the driver."""
    spark = core.sparkSession
    order = F.array_position(F.array(*map(F.lit, SCORING)), F.col("relation"))
    by_target = F.struct(order.alias("o"), F.col("to").alias("p"), F.length("target").alias("n"), "target", "relation", "analysis", "at")
    first = settle(core.groupBy("source").agg(F.min(by_target).alias("e")).select("source", F.col("e.target").alias("target"), "e.relation", "e.analysis", F.col("e.p").alias("to"), "e.at"))
    start = first.agg(F.min(F.struct("at", F.length("source").alias("n"), "source"))).first()[0].source
    path, jump = settle(spark.createDataFrame([(start,)], "source string")), first.select("source", "target")
    while True:
        more = settle(path.join(jump, "source").select(F.col("target").alias("source")).distinct().join(path, "source", "left_anti"))
        if not more.limit(1).count():
            break
        path = settle(path.unionByName(more))
        jump = settle(jump.join(jump.select(F.col("source").alias("target"), F.col("target").alias("_t")), "target").select("source", F.col("_t").alias("target")))
    by = {r.source: r for r in first.join(path, "source", "left_semi").collect()}
    trail, on, x = [], {}, start
    while x not in on:
        on[x] = len(trail)
        trail.append((by[x].relation, x, by[x].target))
        x = by[x].target
    closing = trail[on[x] :]
    kinds = {e[2]: "analysis" for e in closing if by[e[1]].analysis}
    return start, _cut_of(closing, kinds, lambda e: ((by[e[1]].at, len(e[1]), e[1]), (by[e[1]].to, len(e[2]), e[2])))


CUT = "first long, start string, seq int, relation string, source string, target string"


def _cuts_of_part(part):
    """The cuts of one weakly connected part, in one task."""
    import pandas as pd

    far = 1 + max(int(part["at"].max()), int(part["to"].max()))
    rank = {**dict(zip(part["target"], part["to"], strict=True)), **dict(zip(part["source"], part["at"], strict=True))}
    rows = cuts_by_start(list(zip(part["relation"], part["source"], part["target"], strict=True)), rank, {t: "analysis" for t, a in zip(part["target"], part["analysis"], strict=True) if a})
    return pd.DataFrame([(rank.get(s, far), s, i, *cut) for i, (s, cut) in enumerate(rows)], columns=["first", "start", "seq", "relation", "source", "target"])


def cycle_cuts(edges: DataFrame, nodes: DataFrame, hosted: DataFrame | Sequence[str] = ()) -> DataFrame:
    """rank, relation, source, target of every scoring edge that breaking the cycles demotes. `hosted`: ids in reading order, or a table (id, rank).

    Walks don't cross weakly connected parts, so each part of the core is cut in a task of its own; a part of more than
    KERNEL_EDGES edges loses one edge at a time by distributed rounds until it fits.
    """
    spark = nodes.sparkSession
    if not isinstance(hosted, DataFrame):
        hosted = spark.createDataFrame([(x, i) for i, x in enumerate(hosted)], "id string, rank long")
    far, place = F.lit(2**62), hosted.select(F.col("id").alias("_id"), F.col("rank").cast("long").alias("_p"))
    scored = edges.where(F.col("relation").isin(*SCORING)).select("relation", "source", "target").distinct()
    placed = scored
    for end, name in (("source", "at"), ("target", "to")):
        placed = placed.join(place, F.col(end) == F.col("_id"), "left").withColumn(name, F.coalesce("_p", far)).drop("_id", "_p")
    kinds = nodes.where("kind = 'analysis'").select(F.col("id").alias("_id")).distinct()
    placed = placed.join(kinds, F.col("target") == F.col("_id"), "left").withColumn("analysis", (F.col("relation") == "supports") & F.col("_id").isNotNull()).drop("_id")
    core, seq, out = cyclic_core(placed), 0, []
    while True:
        if not core.limit(1).count():
            break
        members = components(core.select(F.col("source").alias("u"), F.col("target").alias("v")))
        parted = settle(core.join(members, F.col("source") == F.col("u"), "left").select(*core.columns, F.coalesce("v", "source").alias("part")))
        large = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > KERNEL_EDGES).select(F.col("part").alias("_large"))
        large = settle(large)
        small = parted.join(large, F.col("part") == F.col("_large"), "left_anti")
        out.append(settle(small.groupBy("part").applyInPandas(_cuts_of_part, CUT)))
        name = large.agg(F.min("_large")).first()[0]
        if name is None:
            break
        # One cut of one large part; the rest of the large parts goes round again.
        start, cut = _next_cut(parted.where(F.col("part") == name))
        first = hosted.where(F.col("id") == start).agg(F.min("rank")).first()[0]
        out.append(spark.createDataFrame([(2**62 if first is None else first, start, seq - 2**30, *cut)], CUT))
        seq += 1
        rest = parted.join(large, F.col("part") == F.col("_large"), "left_semi").drop("part")
        core = cyclic_core(rest.where(~((F.col("relation") == cut[0]) & (F.col("source") == cut[1]) & (F.col("target") == cut[2]))))
    if not out:
        return spark.createDataFrame([], "rank int, relation string, source string, target string")
    cuts = functools.reduce(DataFrame.unionByName, out)
    return before(cuts, [F.col("first"), F.length("start"), F.col("start"), F.col("seq")], {"rank": 1}).select((F.col("rank") + 1).cast("int").alias("rank"), "relation", "source", "target")


def reduced(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Supports pairs, in order, less those whose target stays within reach over what is kept and what is still to come."""
    ways = defaultdict(set)
    for a, b in pairs:
        ways[a].add(b)
    kept = []
    for a, b in pairs:
        ways[a].discard(b)
        stack, seen = [a], set()
        while stack and b not in seen:
            new = ways[stack.pop()] - seen
            seen |= new
            stack += new
        if b not in seen:
            ways[a].add(b)
            kept.append((a, b))
    return kept


def _trimmed(pairs: DataFrame) -> DataFrame:
    """The distinct pairs left after dropping, again and again, those from nodes without a way in and into nodes without a way on."""
    left, n = pairs, -1
    while n:
        # Where no node has both, nothing of the pairs is copied.
        ends = stored(left.select(F.col("source").alias("_x")).distinct().join(left.select(F.col("target").alias("_x")).distinct(), "_x", "left_semi"))
        if not ends.limit(1).count():
            return left.limit(0)
        left = left.join(ends, F.col("source") == F.col("_x"), "left_semi").join(ends, F.col("target") == F.col("_x"), "left_semi")
        left = stored(left.distinct() if n < 0 else left)
        n, before = left.count(), n
        if n == before:
            break
    return left


def strong_parts(pairs: DataFrame) -> DataFrame:
    """id, part of every node on a cycle of two nodes or more: the least id of its strongly connected part, or another id that no other part has."""
    out = pairs.select(F.col("source").alias("id"), F.col("source").alias("part")).limit(0)
    left = _trimmed(pairs.where("source <> target").select("source", "target"))
    while left.limit(1).count():
        # Each node takes the least id that reaches it; the part of that id is what reaches it back within its colour.
        colour = settle(left.select(F.col("source").alias("id")).union(left.select("target")).distinct().withColumn("part", F.col("id")))
        while True:
            step = left.join(colour, F.col("source") == F.col("id")).groupBy("target").agg(F.min("part").alias("_p"))
            new = settle(colour.join(step, F.col("id") == F.col("target"), "left").select("id", F.least("part", "_p").alias("part"), (F.col("_p") < F.col("part")).alias("_moved")))
            colour = new.select("id", "part")
            if not new.where("_moved").limit(1).count():
                break
        inside = settle(left.join(colour.select(F.col("id").alias("source"), "part"), "source").join(colour.select(F.col("id").alias("target"), "part"), ["target", "part"]))
        front = seen = settle(colour.where("id = part"))
        while front.limit(1).count():
            front = settle(inside.join(front.select(F.col("id").alias("target"), "part"), ["target", "part"], "left_semi").select(F.col("source").alias("id"), "part").distinct().join(seen, ["id", "part"], "left_anti"))
            seen = settle(seen.unionByName(front))
        out = settle(out.unionByName(seen))
        done = seen.select(F.col("id").alias("_x"))
        left = _trimmed(left.join(done, F.col("source") == F.col("_x"), "left_anti").join(done, F.col("target") == F.col("_x"), "left_anti"))
    return out


def shortcuts(pairs: DataFrame) -> DataFrame:
    """The pairs of an acyclic graph whose target is also reached by a longer way."""
    middle = stored(pairs.select(F.col("source").alias("_m")).distinct().join(pairs.select(F.col("target").alias("_m")).distinct(), "_m", "left_semi"))
    if not middle.limit(1).count():  # no way is longer than a pair
        return pairs.limit(0)
    left = stored(pairs.distinct())
    # Only what has another way out and in, over a node that has both, can be one.
    on = left.join(middle.select(F.col("_m").alias("source"), F.lit(1).alias("_s")), "source", "left").join(middle.select(F.col("_m").alias("target"), F.lit(1).alias("_t")), "target", "left").fillna(0, ["_s", "_t"])
    out, into = on.groupBy("source").agg(F.sum("_t").alias("_o")), on.groupBy("target").agg(F.sum("_s").alias("_i"))
    open_ = settle(on.join(out, "source").join(into, "target").where("_o > _t and _i > _s").select("source", "target"))
    front = settle(left.join(middle.select(F.col("_m").alias("target")), "target", "left_semi").join(open_.select("source").distinct(), "source", "left_semi").select(F.col("source").alias("start"), F.col("target").alias("node")))
    found, seen = open_.limit(0), front
    while front.limit(1).count():
        step = settle(front.join(left, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct())
        found = settle(found.unionByName(open_.join(step.select(F.col("start").alias("source"), F.col("node").alias("target")), ["source", "target"], "left_semi")))
        open_ = settle(open_.join(found, ["source", "target"], "left_anti"))
        front = settle(step.join(seen, ["start", "node"], "left_anti").join(middle.select(F.col("_m").alias("node")), "node", "left_semi").join(open_.select(F.col("source").alias("start")).distinct(), "start", "left_semi").select("start", "node"))
        seen = settle(seen.unionByName(front))
    return found


def needless(pairs: DataFrame) -> DataFrame:
    """The pairs that `reduced` drops from all pairs in order.

    Reach never changes, so pairs inside a strongly connected part depend on those of the part alone; of those between two parts, all
    go if a third part lies between, else all but the last.
    """
    parts = strong_parts(pairs)
    if not parts.limit(1).count():  # every node is a part of its own
        return shortcuts(pairs.where("source <> target").select("source", "target"))
    ends = pairs.select("source", "target").distinct().join(parts.select(F.col("id").alias("source"), F.col("part").alias("_a")), "source", "left").join(parts.select(F.col("id").alias("target"), F.col("part").alias("_b")), "target", "left")
    ends = settle(ends.select("source", "target", F.coalesce("_a", "source").alias("a"), F.coalesce("_b", "target").alias("b")))
    inner = ends.where("a = b and (source <> target)").unionByName(ends.where("source = target").join(parts.select(F.col("id").alias("source")), "source", "left_semi"))

    def dropped(part):
        rows = sorted(zip(part["source"], part["target"], strict=True))
        kept = set(reduced(rows))
        return part[[(a, b) not in kept for a, b in zip(part["source"], part["target"], strict=True)]][["source", "target"]]

    inside = inner.groupBy("a").applyInPandas(dropped, "source string, target string")
    between = ends.where("a <> b")
    one = between.groupBy("a", "b").agg(F.max(F.struct("source", "target")).alias("last"), F.count(F.lit(1)).alias("_n"))
    over = shortcuts(one.select(F.col("a").alias("source"), F.col("b").alias("target"))).select(F.col("source").alias("a"), F.col("target").alias("b"))
    long = between.join(over, ["a", "b"], "left_semi").select("source", "target")
    double = between.join(one.where("_n > 1").join(over, ["a", "b"], "left_anti"), ["a", "b"]).where("struct(source, target) <> last").select("source", "target")
    return inside.unionByName(long).unionByName(double)


def transitive_reduction(edges: DataFrame, within: str | None = None) -> DataFrame:
    """Edges less the supports edges that others make needless, of all edges or of those with the same `within`."""
    mark = lambda c: F.col(c) if within is None else F.concat(F.col(within), F.lit("\n"), c)
    supports = edges.where(F.col("relation") == "supports")
    gone = stored(needless(supports.select(mark("source").alias("source"), mark("target").alias("target"))).select(F.col("source").alias("_s"), F.col("target").alias("_t")))
    kept = supports.join(gone, (mark("source") == F.col("_s")) & (mark("target") == F.col("_t")), "left_anti")
    return edges.where(F.col("relation") != "supports").unionByName(kept)


def contract(pointers: DataFrame) -> DataFrame:
    """id, root of (id, into): chains followed to their ends by pointer doubling."""
    out = settle(pointers.select("id", F.col("into").alias("root")))
    while True:
        hop = settle(out.join(out.select(F.col("id").alias("_i"), F.col("root").alias("_r")), F.col("root") == F.col("_i"), "left").select("id", F.coalesce("_r", "root").alias("new"), "root"))
        moved = hop.where(F.col("new") != F.col("root")).limit(1).count()
        out = hop.select("id", F.col("new").alias("root"))
        if not moved:
            return out


def neighbourhood(nodes: DataFrame, edges: DataFrame, volume: str) -> tuple[DataFrame, DataFrame]:
    """A volume's nodes with those one edge away, and the edges that touch it."""
    own = nodes.where(F.col("host").startswith(volume + "/")).select("id")
    touch = edges.join(own.select(F.col("id").alias("source")), "source", "left_semi").unionByName(edges.join(own.select(F.col("id").alias("target")), "target", "left_semi")).distinct()
    near = own.union(touch.select("source")).union(touch.select("target")).distinct()
    return nodes.join(near, "id", "left_semi"), touch


def in_order(edges: DataFrame) -> DataFrame:
    return edges.orderBy(relation_rank(F.col("relation")), "source", "target")
