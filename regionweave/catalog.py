"""All registered queries of the spatial engine, collected from their modules."""

from __future__ import annotations

from .plans import documents, relations, specs, structures

MODULES = (relations, structures, specs, documents)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
