"""Named queries over the fixture tables, each with DuckDB oracle SQL where SQL can say it."""

from . import q_changes, q_documents, q_integrity, q_reads, q_scoring, q_streaming, q_workflow  # noqa: F401  (registers queries)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
