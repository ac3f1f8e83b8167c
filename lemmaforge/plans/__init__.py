"""Registered queries over the driver's tables."""

from lemmaforge.plans import entry_queries, lookup_queries, navigation_queries, page_queries, render_queries, source_queries, validate_queries  # noqa: F401
from lemmaforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
