"""Registry of the engine's own queries; plan modules add to it on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: registers a (spark, sf_dir) function and, where SQL can express it, its DuckDB twin."""

    def keep(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import helixframe.plans.all  # noqa: F401  registers on import

    return QUERIES


def oracle_sql() -> dict[str, str]:
    import helixframe.plans.all  # noqa: F401

    return ORACLES
