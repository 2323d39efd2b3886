"""The registered queries and their equivalent SQL."""

from __future__ import annotations

from brindle.plans import audit_queries, corpus_queries, game_queries, search_queries, session_queries, table_queries  # noqa: F401  (they register)
from brindle.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
