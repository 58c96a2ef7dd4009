"""The registered queries."""

from . import bills_queries, page_queries, provider_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "bills_queries", "page_queries", "provider_queries", "text_queries"]
