"""Queries over the driver's tables, one or more for each operator, with the SQL of each."""

from __future__ import annotations

from parlance.plans import aligned_queries, dataset_queries, learner_queries, lookup_queries, model_queries, pair_queries, structural_queries, text_queries, weight_queries  # noqa: F401  they register their queries
from parlance.plans.registry import QUERIES, SQL

FLAGSHIP = QUERIES["greedy_match"]

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
