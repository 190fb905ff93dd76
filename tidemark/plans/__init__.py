"""The library's operators applied to the given tables."""

from tidemark.plans import core_queries, detail_queries, evidence_queries, graph_queries, more_queries, record_queries, repo_queries, review_queries, risk_queries, score_queries, series_queries, stream_queries, text_queries, tree_queries, walk_queries
from tidemark.plans.registry import QUERIES, SQL, query, ship

__all__ = ["QUERIES", "SQL", "core_queries", "detail_queries", "evidence_queries", "graph_queries", "more_queries", "query", "record_queries", "repo_queries", "review_queries", "risk_queries", "score_queries", "series_queries", "ship", "stream_queries", "text_queries", "tree_queries", "walk_queries"]
