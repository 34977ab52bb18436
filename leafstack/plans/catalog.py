"""All named queries."""

from . import check_queries, edit_queries, graph_queries, page_queries, scalar_queries, search_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
