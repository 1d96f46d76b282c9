"""All registered graph queries and their DuckDB statements."""

from __future__ import annotations

from severa.plans import coarse_queries, graph_queries, import_queries, run_queries

MODULES = (graph_queries, import_queries, run_queries, coarse_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
