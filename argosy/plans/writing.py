"""Queries on write batches: what a batch over the star's records and documents would change."""

from __future__ import annotations

from pyspark.sql import functions as F

from argosy.operators import write
from argosy.plans.registry import on_docs

_BATCH = [
    {"op": "add-claim", "id": "clm-new001", "title": "New", "rigor": 0.5, "document": "parts/p4.md", "line": 5},
    {"op": "add-edge", "relation": "supports", "source": "clm-new001", "target": "clm-p00004", "bearing": 0.5},
    {"op": "edit-claim", "id": "clm-p00005", "rigor": 0.25},
    {"op": "edit-claim", "id": "clm-p00008", "new_id": "clm-renamd"},
    {"op": "move-node", "id": "clm-p00003", "document": "parts/p9.md", "line": 5},
    {"op": "remove-node", "id": "exp-000007"},
    {"op": "cite-bare-ids", "document": "parts/p1.md"},
]


def _changes(d, n, e):
    fields = ["kind", "id", "title", "label", "status", "rigor", "manually_scored", "host"]
    state = write.State(n.select(*fields), e, d.select("path", "text"))
    return write.dry_run(state, _BATCH).groupBy("table").agg(F.sum("lost").alias("lost"), F.sum("added").alias("added"))


#: Documents: p4 (new marker), p3 and p9 (moved marker), p2 (cites p3), p7 and p8 (rename), p1 (bare id with a host; cites p2).
on_docs(
    "write_batch",
    """, x as (select relation, source, target, 'clm-p00008' in (source, target) as renamed, 'exp-000007' in (source, target) as gone from e)
  select 'nodes' as "table", 4::bigint as lost, 4::bigint as added union all select 'edges', count(*) filter (renamed or gone), count(*) filter (renamed and not gone) + 1 from x
  union all select 'documents', 7, 7""",
    _changes,
)
