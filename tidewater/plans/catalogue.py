"""All registered queries over the reference tables and their oracle SQL."""

from __future__ import annotations

from tidewater.plans import changes, relational  # noqa: F401  they register their queries
from tidewater.plans.registry import Query, oracle_sql, queries

__all__ = ["Query", "oracle_sql", "queries"]
