"""All queries of the engine itself."""

from __future__ import annotations

from quern.plans import search_queries, table_queries, user_queries  # noqa: F401  they register their queries
from quern.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
