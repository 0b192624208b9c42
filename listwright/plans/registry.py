"""Where the modules of queries register what they offer."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from listwright.sources.shared import shipped

FLAGSHIP = "w04_representatives"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with DuckDB SQL that gives the same rows."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(shipped(spark), sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
