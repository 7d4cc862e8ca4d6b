"""Every query of the core and its SQL."""

from __future__ import annotations

import importlib

MODULES = ["orphans", "history", "graph", "health", "texts", "views", "extraction", "streams", "refactor", "known"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"codestrata.plans.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
