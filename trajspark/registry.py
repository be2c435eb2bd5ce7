"""All registered queries: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "reward_by_source"
_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that must give the same rows."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = (f, sql)
        return f

    return add


def _load() -> dict[str, tuple[Callable, str | None]]:
    from . import plans  # noqa: F401  registers its queries

    plans.load()
    return _QUERIES


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _load().items() if s is not None}
