"""All queries of the core library by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("retrieval", "reading", "library", "chunks", "formats", "pages", "exports")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"foliant.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"foliant.plans.{m}").SQL.items()}
