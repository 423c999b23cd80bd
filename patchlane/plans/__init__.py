"""The registered queries and the views that they read."""

from __future__ import annotations

import importlib

MODULES = ("result_queries", "metric_queries", "vector_queries", "grid_queries", "run_queries")


def all_queries() -> tuple[dict, dict]:
    """Name to query, and name to SQL."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.SQL
