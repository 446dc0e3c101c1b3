"""Registered queries over the provided tables, each with SQL where it is feasible."""
from __future__ import annotations

from gleanmark.catalog import files, matching, profiles, prompts, runs, salvage, selection, stream

MODULES = (matching, salvage, selection, profiles, runs, prompts, files, stream)


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _sql) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_q, sql) in m.QUERIES.items() if sql is not None}
