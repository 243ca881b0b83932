"""Registered queries with their check SQL."""

from . import article_queries, graph_queries, history_queries, markup_queries, search_queries, word_queries  # noqa: F401
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
