"""Every operator as a query over the given tables."""

from . import choice_queries, logs_and_cohorts, report_queries, stat_queries, trial_metrics
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "choice_queries", "logs_and_cohorts", "report_queries", "stat_queries", "trial_metrics"]
