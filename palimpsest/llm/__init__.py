"""Operators that prepare training data. Nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "media", "packing", "secrets", "sharding", "simhash", "substrings", "token_counts", "topk", "toxicity")


def queries() -> dict:
    """Registered queries of every operator, by name."""
    return {name: q for m in MODULES for name, q in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    return {name: sql for m in MODULES for name, sql in getattr(import_module(f"{__name__}.{m}"), "ORACLE_SQL", {}).items()}
