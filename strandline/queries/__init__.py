"""Registered queries of the reference's operators, each with SQL where SQL can express it."""

from __future__ import annotations

from . import events, panels, regressions

MODULES = (panels, events, regressions)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
