"""All registered queries of the claim graph: importing this module registers them."""

from __future__ import annotations

from argosy.plans import building, catalog, files, judging, loops, migrating, outlining, refreshing, streaming, texts, writing
from argosy.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "building", "catalog", "files", "judging", "loops", "migrating", "outlining", "refreshing", "streaming", "texts", "writing"]
