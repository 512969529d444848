"""lapcast: panel time-series preparation, forecasting and evaluation on Spark."""

from lapcast.roles import Roles

__all__ = ["Roles"]
