"""All queries of the spreadsheet engine."""

from sheafcalc.plans import audit_queries, cell_queries, function_queries, graph_queries  # noqa: F401  they register their queries
from sheafcalc.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
