"""Estimators, marts and the registered queries."""

from obsengine.plans import gate_queries, mart_queries, model_queries, more_queries, source_queries  # noqa: F401  register their queries
from obsengine.plans.observation_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
