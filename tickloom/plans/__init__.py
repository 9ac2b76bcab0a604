"""All registered queries."""

from . import bar_queries, experiment_queries, file_queries, indicator_queries, model_queries, outcome_queries, stream_queries, text_queries, trade_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
