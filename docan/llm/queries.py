"""Queries of the subpackage, by name."""

from __future__ import annotations

from importlib import import_module
from types import SimpleNamespace

MODULES = ("leak_queries", "span_queries", "form_queries", "packing_queries", "language_queries", "duplicate_queries", "name_queries", "personal_queries", "scan_queries")

registry = SimpleNamespace(queries={}, oracles={})
for _name in MODULES:
    _module = import_module(f"docan.llm.{_name}")
    registry.queries.update(_module.registry.queries)
    registry.oracles.update(_module.registry.oracles)
