"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("panels", "series", "joins", "features", "forecasts", "rules", "learning", "sources", "ledger", "jobs")


def load():
    """Import every query module and return (queries, checking SQL)."""
    for name in MODULES:
        import_module(f"tidemark.catalog.{name}")
    from tidemark.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
