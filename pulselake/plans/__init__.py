"""Queries over the tables: importing this package registers them."""

from . import experiment_queries, jobs, metric_queries, model_queries, stream_queries, stress, temporal_queries, window_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
