"""Write batches over immutable snapshots: operations applied in order, all or none.

A batch is a small list of operations (an author's edits), checked and applied to new DataFrames of nodes, edges and documents; a dry
run is the difference of the two snapshots. Nothing is updated in place: `commit` writes the new tables beside the old ones and then
claims the next version, which only one writer of those that read the same version can.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.functions import markdown as M
from argosy.functions import text as T
from argosy.functions.graph import BEARING_SOURCES, BEARING_TARGETS, KIND_OF, SCORING
from argosy.operators.build import multiset_diff
from argosy.operators.graph import shortest_path
from argosy.operators.query import Refused


@dataclass(frozen=True)
class State:
    nodes: DataFrame
    edges: DataFrame
    docs: DataFrame | None = None  # path, text


def _kind(id: str) -> str:
    return KIND_OF.get(id[:3], "")


def _has(df: DataFrame, **at) -> bool:
    held = F.lit(True)
    for c, v in at.items():
        held &= F.col(c).eqNullSafe(F.lit(v))
    return df.where(held).limit(1).count() > 0


def _row(df: DataFrame, **values) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values.get(f.name) for f in df.schema.fields)], df.schema)


def _edge(op: dict):
    return (F.col("relation") == op["relation"]) & (F.col("source") == op["source"]) & (F.col("target") == op["target"])


def add_node(s: State, op: dict) -> State:
    kind = _kind(op["id"])
    if not kind or _has(s.nodes, id=op["id"]):
        raise Refused([f"{op['id']} is no new id"])
    if kind in ("work", "axiom") and (not op.get("label") or _has(s.nodes, kind=kind, label=op["label"])):
        raise Refused([f"{kind} needs a label of its own"])
    fields = {k: v for k, v in op.items() if k in s.nodes.columns}
    if "rigor" in fields:
        fields.setdefault("manually_scored", True)  # a caller's value
    s = replace(s, nodes=s.nodes.unionByName(_row(s.nodes, kind=kind, **fields)))
    if kind == "axiom" and s.docs is not None:
        heading = f"\n## {op['label']} {op.get('title') or ''} <!-- {T.PREFIX}: {op['id']} -->\n"
        return replace(s, docs=_edited(s.docs, "axioms.md", lambda text: text.rstrip("\n") + "\n" + heading))
    return _marked(s, op) if "document" in op else s


def edit_node(s: State, op: dict) -> State:
    if not _has(s.nodes, id=op["id"]):
        raise Refused([f"{op['id']} is unknown"])
    changed = {c: v for c, v in op.items() if c not in ("op", "id")}
    if "rigor" in changed and "manually_scored" not in changed:
        changed["manually_scored"] = True  # a caller's value
    if "judged_hash" in s.nodes.columns and "rigor" in changed:
        changed.setdefault("judged_hash", None)  # a person's value was judged by no call
    new = changed.pop("new_id", None)
    s = replace(s, nodes=s.nodes.select(*[F.when(F.col("id") == op["id"], F.lit(changed[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c, t in s.nodes.dtypes]))
    return renamed(s, op["id"], new) if new else s


def renamed(s: State, old: str, new: str) -> State:
    """The state with a node under another id: its record, its edges' ends, and its markers and citations in documents."""
    if _kind(new) != _kind(old) or _has(s.nodes, id=new):
        raise Refused([f"{new} is no new id of that kind"])
    swap = lambda df, *names: df.select(*[F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])
    docs = s.docs if s.docs is None else s.docs.withColumn("text", F.regexp_replace("text", rf"\b{old}\b", new))
    return State(swap(s.nodes, "id"), swap(s.edges, "source", "target"), docs)


def _edited(docs: DataFrame, path: str, edit: Callable[[str], str]) -> DataFrame:
    """The documents with one of them rewritten; an unknown path is refused."""
    found = docs.where(F.col("path") == path).select("text").limit(1).collect()
    if not found:
        raise Refused([f"{path} is no document"])
    return docs.select(*[F.when(F.col("path") == path, F.lit(edit(found[0].text))).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def _marked(s: State, op: dict) -> State:
    """The state with a marker of the node on a document's line, and the node hosted there."""
    if s.docs is None:
        raise Refused(["there are no documents"])
    docs = _edited(s.docs, op["document"], lambda text: M.add_marker(text, op["line"], op["id"]))
    return replace(s, docs=docs, nodes=s.nodes.withColumn("host", F.when(F.col("id") == op["id"], F.lit(op["document"])).otherwise(F.col("host"))))


def mentions(docs: DataFrame, id: str) -> list[str]:
    """path:line of the first places where documents name an id outside its own markers."""
    plain = T.udf(lambda x: [i + 1 for i, line in enumerate(T.without_markers(x).split("\n")) if id in line], "array<int>")
    held = docs.where(F.contains("text", F.lit(id))).select("path", F.explode(plain("text")).alias("line"))
    return [f"{r.path}:{r.line}" for r in held.orderBy("path", "line").limit(20).collect()]


def remove_node(s: State, op: dict) -> State:
    gone = s.nodes.where(F.col("id") == op["id"])
    if not gone.limit(1).count():
        raise Refused([f"{op['id']} is unknown"])
    docs = s.docs
    if docs is not None:
        if named := mentions(docs, op["id"]):
            raise Refused([f"{op['id']} is named at {x}" for x in named])
        held = F.contains("text", F.lit(op["id"]))
        docs = docs.withColumn("text", F.when(held, T.udf(lambda x: M.drop_marker(x, op["id"]), "string")(F.when(held, F.col("text")))).otherwise(F.col("text")))
    return State(s.nodes.where(F.col("id") != op["id"]), s.edges.where((F.col("source") != op["id"]) & (F.col("target") != op["id"])), docs)


def move_node(s: State, op: dict) -> State:
    """A node's host changes; with documents its marker moves to the new line, and links that cite it by id lead there."""
    if s.docs is None or "line" not in op:
        return edit_node(s, {"id": op["id"], "host": op.get("host") or op["document"]})
    id, to = op["id"], op["document"]
    held = F.contains("text", F.lit(id))

    def moved(row: str) -> str:
        path, text = row.split("\0", 1)
        text = M.drop_marker(text, id)
        return T.LINK.sub(lambda m: m[0].replace(m[2], M.link_to(path, to), 1) if m[3] and m[3][1:-1] == id else m[0], text)

    anew = T.udf(moved, "string")(F.when(held, F.concat_ws("\0", "path", "text")))
    return _marked(replace(s, docs=s.docs.withColumn("text", F.when(held, anew).otherwise(F.col("text")))), op)


def cite(s: State, op: dict) -> State:
    """A span of a document's line becomes a citation of a node."""
    if not _has(s.nodes, id=op["id"]) or s.docs is None:
        raise Refused([f"{op['id']} is unknown"])
    host = s.nodes.where(F.col("id") == op["id"]).select("host").first()[0] or op["document"]
    try:
        return replace(s, docs=_edited(s.docs, op["document"], lambda text: M.add_citation(text, op["line"], op["snippet"], M.link_to(op["document"], host), op["id"])))
    except ValueError as error:
        raise Refused([str(error)]) from None


def cite_bare(s: State, op: dict) -> State:
    """Every bare id in a document that a node carries becomes a citation by title."""
    ids = sorted({x for r in s.docs.where(F.col("path") == op["document"]).collect() for line in T.strip_code(r.text).split("\n") for x in T.bare_ids(line)})
    rows = {r.id: r for r in s.nodes.where(F.col("id").isin(ids)).select("id", "title", "host").collect()} if ids else {}
    hosts = {i: M.link_to(op["document"], r.host) for i, r in rows.items() if r.host}
    return replace(s, docs=_edited(s.docs, op["document"], lambda text: M.cite_bare_ids(text, {i: r.title for i, r in rows.items()}, hosts)))


def split_claim(s: State, op: dict) -> State:
    """A claim's remaining text becomes an analysis that lifts it, marked on its own line."""
    s = add_node(s, {"id": op["new_id"], "title": op["title"], "document": op["document"], "line": op["line"]})
    return add_edge(s, {"relation": "lifts", "source": op["new_id"], "target": op["id"], "manually_scored": False})


def add_build_edges(s: State, op: dict) -> State:
    """Edges of a build, whose values a model is to set."""
    for edge in op["edges"]:
        s = add_edge(s, {**edge, "manually_scored": False})
    return s


def add_edge(s: State, op: dict) -> State:
    a, b, relation = op["source"], op["target"], op["relation"]
    items = [f"{x} is unknown" for x in (a, b) if not _has(s.nodes, id=x)]
    if relation in BEARING_SOURCES and (_kind(a) not in BEARING_SOURCES[relation] or _kind(b) not in BEARING_TARGETS):
        items.append(f"{relation} doesn't join {_kind(a)} and {_kind(b)}")
    if relation == "references" and op.get("bearing") is not None:
        items.append("a reference has no bearing")
    if items:
        raise Refused(items)
    if _has(s.edges.where(_edge(op))):
        if _has(s.edges.where(_edge(op)), bearing=op.get("bearing"), context=op.get("context", "")):
            return s  # moves no byte
        raise Refused(["the edge stands"])
    if relation in SCORING and (a == b or shortest_path(s.edges.where(F.col("relation").isin(*SCORING)), b, a) is not None):
        raise Refused(["the edge closes a cycle"])
    kept = s.edges.where(~((F.col("relation") == "demoted") & F.col("replaced_relation").eqNullSafe(F.lit(relation)) & (F.col("source") == a) & (F.col("target") == b)))
    pending = relation in SCORING and op.get("bearing") is None
    return replace(s, edges=kept.unionByName(_row(s.edges, relation=relation, source=a, target=b, context=op.get("context", ""), bearing=op.get("bearing"), bearing_pending=pending if relation != "references" else None, manually_scored=op.get("manually_scored", True))))


def _standing(s: State, op: dict) -> None:
    if not _has(s.edges.where(_edge(op))):
        raise Refused(["no such edge"])


def edit_edge(s: State, op: dict) -> State:
    _standing(s, op)
    put = lambda c, v: F.when(_edge(op), v).otherwise(F.col(c)).alias(c)
    new = {"bearing": F.lit(op["bearing"]).cast("double"), "bearing_pending": F.lit(op["bearing"] is None), "manually_scored": F.lit(True)} if "bearing" in op else {}
    new |= {"context": F.lit(op["context"])} if "context" in op else {}
    return replace(s, edges=s.edges.select(*[put(c, new[c]) if c in new else F.col(c) for c in s.edges.columns]))


def remove_edge(s: State, op: dict) -> State:
    _standing(s, op)
    return replace(s, edges=s.edges.where(~_edge(op)))


def demote_edge(s: State, op: dict) -> State:
    _standing(s, op)
    own = _edge(op)
    return replace(s, edges=s.edges.select(*[F.when(own, F.col("relation")).otherwise(F.col(c)).alias(c) if c == "replaced_relation" else F.when(own, F.lit("demoted")).otherwise(F.col(c)).alias(c) if c == "relation" else F.col(c) for c in s.edges.columns]))


def restore_edge(s: State, op: dict) -> State:
    own = (F.col("relation") == "demoted") & (F.col("replaced_relation") == op["relation"]) & (F.col("source") == op["source"]) & (F.col("target") == op["target"])
    if not s.edges.where(own).limit(1).count():
        raise Refused(["no such demoted edge"])
    if shortest_path(s.edges.where(F.col("relation").isin(*SCORING)), op["target"], op["source"]) is not None:
        raise Refused(["the edge closes a cycle"])
    return replace(s, edges=s.edges.select(*[F.when(own, F.col("replaced_relation")).otherwise(F.col(c)).alias(c) if c == "relation" else F.when(own, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "replaced_relation" else F.col(c) for c in s.edges.columns]))


OPERATIONS: dict[str, Callable[[State, dict], State]] = (
    {f"add-{k}": add_node for k in ("claim", "analysis", "experiment", "work", "axiom")}
    | {f"edit-{k}": edit_node for k in ("claim", "analysis", "experiment", "work", "axiom")}
    | {"remove-node": remove_node, "move-node": move_node, "add-edge": add_edge, "edit-edge": edit_edge, "remove-edge": remove_edge, "demote-claim-edge": demote_edge, "restore-demoted": restore_edge}
    | {"add-citation": cite, "cite-bare-ids": cite_bare, "split-claim": split_claim, "add-build-edges": add_build_edges}
)
#: What each operation takes: fields it needs, and fields it may have.
VOCABULARY: dict[str, tuple[set[str], set[str]]] = (
    {f"add-{k}": ({"id", "title"} | ({"label"} if k in ("work", "axiom") else set()), {"label", "status", "rigor", "rationale", "document", "line"}) for k in ("claim", "analysis", "experiment", "work", "axiom")}
    | {f"edit-{k}": ({"id"}, {"title", "label", "status", "rigor", "rationale", "new_id"}) for k in ("claim", "analysis", "experiment", "work", "axiom")}
    | {"remove-node": ({"id"}, set()), "move-node": ({"id"}, {"host", "document", "line"})}
    | {o: ({"relation", "source", "target"}, {"bearing", "context"}) for o in ("add-edge", "edit-edge")}
    | {o: ({"relation", "source", "target"}, set()) for o in ("remove-edge", "demote-claim-edge", "restore-demoted")}
    | {"add-citation": ({"id", "document", "line", "snippet"}, set()), "cite-bare-ids": ({"document"}, set()), "split-claim": ({"id", "new_id", "title", "document", "line"}, set()), "add-build-edges": ({"edges"}, set())}
)


def value_faults(operations: list[dict]) -> list[str]:
    """Every fault of shape in a batch at once: unknown operations and fields, missing fields, numbers and lines outside their domain."""
    out = []
    for i, op in enumerate(operations, 1):
        name = op.get("op")
        if name not in VOCABULARY:
            out.append(f"operation {i}: {name!r} is unknown")
            continue
        needs, may = VOCABULARY[name]
        own = op.keys() - {"op"}
        out += [f"operation {i}: no {f}" for f in sorted(needs - own)] + [f"operation {i}: {f} is no field" for f in sorted(own - needs - may)]
        for f in ("rigor", "bearing"):
            x = op.get(f)
            if x is not None and (isinstance(x, bool) or not isinstance(x, int | float) or not 0 <= x <= 1):
                out.append(f"operation {i}: {f} is no number in [0, 1]")
        if "line" in op and (not isinstance(op["line"], int) or op["line"] < 1):
            out.append(f"operation {i}: line is no line number")
        for f in ("id", "new_id", "source", "target"):
            if f in op and not re.fullmatch(r"(?:clm|exp|ana|wrk|axm)-[a-z0-9]{6}", str(op[f])):
                out.append(f"operation {i}: {f} is no id")
    return out


def batch(state: State, operations: list[dict]) -> State:
    """The state after all operations; faults of shape refuse the batch with all of them, a refused operation with its number."""
    if faults := value_faults(operations):
        raise Refused(faults)
    for i, op in enumerate(operations):
        try:
            state = OPERATIONS[op["op"]](state, {k: v for k, v in op.items() if k != "op"})
        except Refused as refused:
            raise Refused([f"operation {i + 1}: {x}" for x in refused.items]) from None
    return state


def _tables(s: State) -> list[tuple[str, DataFrame]]:
    return [("nodes", s.nodes), ("edges", s.edges), *([("documents", s.docs)] if s.docs is not None else [])]


def dry_run(state: State, operations: list[dict]) -> DataFrame:
    """table, row (JSON), lost, added: what a batch would change."""
    after = batch(state, operations)
    rows = lambda s: functools.reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in _tables(s)])
    return multiset_diff(rows(state), rows(after), ["table", "row"])


class Contention(RuntimeError):
    """Another writer has claimed the version that this one was to be."""


def version(spark: SparkSession, folder: str) -> int:
    """The last version that was claimed below a folder, 0 if none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/claims")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return max((int(x.getPath().getName()) for x in fs.listStatus(where)), default=0) if fs.exists(where) else 0


def commit(state: State, folder: str, read: int) -> int:
    """Writes the state as the version after `read` and claims it: the claim is a file that only one writer can create, and it names the tables."""
    spark, mark = state.nodes.sparkSession, uuid.uuid4().hex
    for name, df in _tables(state):
        df.write.parquet(f"{folder}/tables/{mark}/{name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/claims/{read + 1:012d}")
    try:
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    except Exception as error:
        raise Contention(f"version {read + 1} stands already") from error
    out.writeBytes(mark)
    out.close()
    return read + 1


def checkout(spark: SparkSession, folder: str, at: int | None = None) -> tuple[State, int]:
    """The state of a version, by default the last, and its number."""
    at = version(spark, folder) if at is None else at
    mark = spark.read.text(f"{folder}/claims/{at:012d}").first()[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tables/{mark}/documents")
    has_docs = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    held = [spark.read.parquet(f"{folder}/tables/{mark}/{name}") for name in ("nodes", "edges", *(["documents"] if has_docs else []))]
    return State(*held), at


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """`base` with the rows of `changes` put in by key."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes)
