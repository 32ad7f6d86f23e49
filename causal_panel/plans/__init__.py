"""Bindings to the given tables and the registered queries."""
from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY, Query

MODULES = (
    "q_sources", "q_scalars", "q_joins", "q_aggs", "q_windows", "q_sets",
    "q_estimators", "q_learning", "q_decisions", "q_capture",
)


def all_queries() -> dict[str, Query]:
    from importlib.util import find_spec
    for name in MODULES:
        if find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
