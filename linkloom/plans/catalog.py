"""All queries over the test tables and their oracles."""

from linkloom.plans import evidence_queries, filter_queries, flow_queries, graph_queries, link_queries, metric_queries, network_queries, profile_queries, record_queries, resolution_queries, scalar_queries, stream_queries, text_queries  # noqa: F401  (they register)
from linkloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
