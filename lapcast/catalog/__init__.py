"""All registered queries; importing the modules registers them."""

from lapcast.catalog import forecasts, preparation, proofs, sequences, statistics  # noqa: F401
from lapcast.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
