"""Names, plans and reference SQL of the library's own queries."""

from __future__ import annotations

from quarry.plans import answers, catalogue, clauses, details, pages, patterns, present, relational, retrieval, speech, stateful, text, whole  # noqa: F401  they register their queries
from quarry.plans.core import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_retrieval"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
