"""Queries over the driver tables, one or more per operator, with their SQL twins."""

from skyledger.queries import dist_queries, feature_queries, metric_queries, model_queries, replay_queries, search_queries, signal_queries, source_queries, tape_queries  # noqa: F401
from skyledger.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
