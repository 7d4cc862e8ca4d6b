"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ["components", "syntax", "credentials", "together", "provenance", "leakage", "keywords", "ideal_point", "packing"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"codestrata.llm.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
