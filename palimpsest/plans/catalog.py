"""All queries of the library but those of the subpackage that may be absent."""

from __future__ import annotations

from palimpsest.plans import aggregates, domain_queries, entity_queries, geometry_queries, graph_queries, joins, lifecycle_queries, more_queries, ranking, scans, surface_queries, text_queries, trial_queries  # noqa: F401
from palimpsest.plans.registry import QUERIES, SQL  # noqa: F401
