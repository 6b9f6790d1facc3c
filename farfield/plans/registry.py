"""All registered queries of the engine's own operators, and the SQL that states their results."""

from __future__ import annotations

from farfield.plans import catalogue, design, fits, inputs, results, scores, tables, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (scores, design, results, inputs, fits, catalogue, tables, written):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
