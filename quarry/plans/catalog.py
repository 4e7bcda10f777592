"""All queries on the driver tables, and their SQL."""

from __future__ import annotations

from quarry.plans import answer_queries, bound_queries, chunk_queries, freshness_queries, grounding_queries, plan_queries, retrieval_queries, statistics_queries, text_queries

_PARTS = (retrieval_queries, plan_queries, statistics_queries, text_queries, grounding_queries, answer_queries, bound_queries, chunk_queries, freshness_queries)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES = {k: s for p in _PARTS for k, s in p.ORACLES.items()}
