"""All registered queries with their SQL."""

from __future__ import annotations

from . import analysis, queries, routing, selection

QUERIES = queries.QUERIES | selection.QUERIES | routing.QUERIES | analysis.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | selection.ORACLE_SQL | routing.ORACLE_SQL | analysis.ORACLE_SQL
