"""All registered queries."""

from . import file_queries, learning_queries, matrix_queries, table_queries, workflow_queries  # noqa: F401  (they register)
from .registry import QUERIES

__all__ = ["QUERIES"]
