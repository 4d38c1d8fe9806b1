"""All registered queries; importing this module fills the registry."""

from panelseq.plans import contract_queries, feature_queries, inference_queries, metric_queries, response_queries, updater_queries  # noqa: F401
from panelseq.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
