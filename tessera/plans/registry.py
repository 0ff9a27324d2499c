"""All queries outside the optional subpackage."""

from __future__ import annotations

from tessera.plans import ORACLES, QUERIES, batch_queries, dataset_queries, loss_queries, pool_queries, rollout_queries, scale_queries, text_queries

FLAGSHIP = "skeleton_pool"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "batch_queries", "dataset_queries", "loss_queries", "pool_queries", "rollout_queries", "scale_queries", "text_queries"]
