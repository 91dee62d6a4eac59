"""The registered queries, by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("encoding", "grouping", "diagnostics", "geometry", "preparation", "composition", "intake")


def _load():
    for name in FAMILIES:
        import_module(f"driftloom.plans.{name}")
    return import_module("driftloom.plans.catalog")


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().SQL)
