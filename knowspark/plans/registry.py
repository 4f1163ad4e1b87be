"""All registered queries: name -> Spark callable, name -> DuckDB oracle SQL."""

from __future__ import annotations

from importlib import import_module

# modules contributing queries() / oracle()
_MODULES = ["search_queries", "security_queries", "memory_queries", "store_queries", "transcript_queries", "file_queries",
            "index_queries"]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(import_module(f"{__package__}.{m}").queries())
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(import_module(f"{__package__}.{m}").oracle())
    return out
