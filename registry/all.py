"""All registered queries."""

from registry import history, projection  # noqa: F401
from registry.core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
