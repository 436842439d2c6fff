"""All registered queries of the engine."""

from tarmac.plans import graph, metrics, predictors, replay, reports, timeseries  # noqa: F401
from tarmac.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
