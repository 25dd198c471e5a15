"""The engine's queries by name, each with the SQL that says the same thing where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under ``name``; a name can be taken once."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in _QUERIES:
            raise KeyError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera import plans  # noqa: F401  registers on import

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _ORACLES
