"""All registered queries and their SQL."""

from __future__ import annotations

from . import catalog_queries, detail_queries, graph_queries, planning_queries, retrieval_queries, text_queries

_PARTS = (retrieval_queries, catalog_queries, text_queries, graph_queries, planning_queries, detail_queries)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
