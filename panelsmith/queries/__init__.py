"""Every registered query, by area."""

from panelsmith.queries import cleaning_queries, model_queries, report_queries, selection_queries  # noqa: F401
from panelsmith.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
