"""All registered queries. Importing a query module registers what it holds."""

from __future__ import annotations

from shapewright.plans import queries_changes, queries_relational, queries_reports, queries_streams  # noqa: F401
from shapewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
