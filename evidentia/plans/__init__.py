"""Ready-made queries, one per operator."""

from __future__ import annotations

from importlib import import_module

from evidentia.plans.registry import ORACLES, QUERIES

MODULES = ["search", "code", "repair", "evaluate", "audit", "textops", "builds", "tasks", "meaning", "score"]


def _load() -> None:
    for name in MODULES:
        import_module(f"evidentia.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
