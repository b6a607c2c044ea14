"""The registered queries, family by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["stage1_queries", "cleaning_queries", "ensemble_queries", "evaluation_queries", "stream_queries", "search_queries", "convergence_queries", "decision_queries", "surrogate_queries", "rolling_queries", "settings_queries"]


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL) of every family."""
    from .. import registry

    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLE_SQL)
