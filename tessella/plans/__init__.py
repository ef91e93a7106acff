"""Queries by name, and the views that they read."""

from . import adapter_queries, graph_queries, io_queries, qa_queries, service_queries, tool_queries, trace_queries, vector_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "adapter_queries", "graph_queries", "io_queries", "qa_queries", "service_queries", "tool_queries", "trace_queries", "vector_queries"]
