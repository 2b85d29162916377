"""Queries over the given tables, one per operator, with the SQL they must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "scans",
    "columns",
    "shaping",
    "aggregates",
    "community",
    "differential",
    "figures",
    "tables",
    "reads",
]


def _load():
    from biotables.catalog import registry

    for name in MODULES:
        import_module(f"biotables.catalog.{name}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
