"""All registered queries."""

from tessera.plans import context, curation, datasets, graph, items, parsed, reports, reviews, scores, streams  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
