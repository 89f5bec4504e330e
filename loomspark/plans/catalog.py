"""Imports every module of queries, which registers them."""

from loomspark.plans import q_checkers, q_data, q_extension, q_extract, q_grading, q_importance, q_pools, q_prompts, q_quality, q_rollouts, q_text  # noqa: F401
from loomspark.plans.registry import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
