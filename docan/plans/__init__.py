"""All queries of the core, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("orphan_queries", "analytics_queries", "extraction_queries", "linking_queries", "rollup_queries", "stream_queries", "layout_queries")


def collect(kind: str) -> dict:
    """``queries`` or ``oracles`` of every module."""
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"docan.plans.{name}").registry, kind))
    return found
