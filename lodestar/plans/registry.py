"""All registered queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
#: Modules whose import registers queries.
MODULES = ("filters", "joins", "aggregates", "windows", "retrieval", "graphs", "temporal", "texts", "streams", "extras")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir), with its SQL where SQL can express it."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"lodestar.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark, sf_dir: str):
    return queries()["F07_hybrid_search"](spark, sf_dir)
