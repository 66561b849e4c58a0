"""All registered queries."""

from tracewell.plans import chunk_queries, evidence_queries, master_queries, operation_queries, retrieval_queries, service_queries, text_queries  # noqa: F401
from tracewell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
