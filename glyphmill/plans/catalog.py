"""All registered queries."""

from __future__ import annotations

from . import change_queries, compile_queries, evidence_queries, index_queries, scope_queries, search_queries, stream_queries, structure_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "change_queries", "compile_queries", "evidence_queries", "index_queries", "scope_queries", "search_queries", "stream_queries", "structure_queries", "text_queries"]
