"""All registered queries. Importing a query module fills the registry."""

from __future__ import annotations

from caseflow.plans import cases, learned, live, quality_loop, raw, silver_gold  # noqa: F401
from caseflow.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
