"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("flagship", "ingest", "reading", "layout", "retrieval", "evidence", "auditing", "study", "records", "streams")


def _load() -> None:
    for name in MODULES:
        import_module(f"quire.plans.{name}")


def all_queries() -> dict:
    from quire.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from quire.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
