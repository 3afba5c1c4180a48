"""Every registered query of the graph engine and its DuckDB twin."""

from __future__ import annotations

from graphloom import queries_sources, queries_tables

QUERIES: dict = {**queries_tables.QUERIES, **queries_sources.QUERIES}
ORACLE_SQL: dict[str, str] = {**queries_tables.ORACLE_SQL, **queries_sources.ORACLE_SQL}
