"""Every registered query, by section of the inventory."""

from scoreflow.catalog import (base_queries, feature_queries, model_checks, model_queries,  # noqa: F401
                               score_queries, selection_queries)
from scoreflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
