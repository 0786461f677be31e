"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("oversize_split", "leakage", "source_mix", "sentences", "near_duplicates", "vector_neighbors", "entity_match", "page_repair")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"foliant.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"foliant.llm.{m}").SQL.items()}
