"""The registered queries of the reference operators."""

from . import assistants, documents, records, relational, scoring, sheets  # noqa: F401  (they register their queries)
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
