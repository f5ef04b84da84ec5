"""Derived inputs and the registered queries with their SQL counterparts."""

from lakescribe.plans import (  # noqa: F401
    dialect_queries,
    fleet_queries,
    lake_queries,
    script_queries,
    text_queries,
)
from lakescribe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
