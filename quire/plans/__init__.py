"""Registered queries over the driver's tables, each with its DuckDB twin where SQL can express it."""

from . import column_queries, dropcap_queries, formatting_queries, fuzzy_queries, guarded_queries, layout_queries, match_queries, page_queries, putback_queries, reorganize_queries, sketch_queries, text_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
