"""Queries over the archive's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pressloom.queries import assemble, documents, graph, retrieval, rollups

_ALL = (documents, retrieval, graph, assemble, rollups)


def queries() -> dict:
    return {name: run for m in _ALL for name, run in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _ALL for name, sql in m.SQL.items()}
