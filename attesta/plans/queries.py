"""All registered queries of the engine."""

from __future__ import annotations

from attesta.plans import catalog, papers, printed, records  # noqa: F401  (they register their queries)
from attesta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
