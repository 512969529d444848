"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from lapcast.llm import queries  # noqa: F401
from lapcast.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
