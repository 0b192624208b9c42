"""The catalogue of queries: each one a plan over the driver's tables with the SQL that says the same."""

from __future__ import annotations

from listwright.plans import changes, duplicates, files, relational, statistics, streams, texts  # noqa: F401  they register their queries
from listwright.plans.registry import FLAGSHIP, oracle_sql, queries

__all__ = ["FLAGSHIP", "oracle_sql", "queries"]
