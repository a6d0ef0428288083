"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import q_annotate, q_counts, q_expression, q_joins, q_metrics, q_region, q_sources, q_spatial, q_stats, registry  # noqa: F401

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL
