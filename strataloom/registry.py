"""All queries of the engine and the SQL that says the same."""

from __future__ import annotations

from .plans import blocks, checks, extras, fields, layout, levels, manage, results, sections, shapes, tasks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _area in (blocks, sections, levels, layout, fields, tasks, manage, extras, shapes, results, checks):
    QUERIES |= _area.REGISTER.queries
    ORACLE_SQL |= _area.REGISTER.oracles
