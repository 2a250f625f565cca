"""Registered queries over the given tables, each next to the SQL it must agree with."""

from fityard.plans import feature_plans, metric_plans, model_plans, runlog_plans, source_plans
from fityard.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "feature_plans", "metric_plans", "model_plans", "runlog_plans",
           "source_plans"]
