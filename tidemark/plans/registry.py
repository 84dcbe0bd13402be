"""All queries over the given tables."""

from __future__ import annotations

from tidemark.plans import feature_queries, function_queries, prepare_queries, research_queries, source_queries, state_queries  # noqa: F401
from tidemark.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "ra2_lift_by_horizon"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
