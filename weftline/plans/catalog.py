"""Name -> query and name -> SQL twin of every operator of the core."""

from __future__ import annotations

from weftline.plans import core_queries, edge_queries, evaluation_queries, graph_queries, io_queries, key_queries, language_queries, link_queries, metric_queries, needs_queries, select_queries, text_queries  # noqa: F401
from weftline.plans.registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "bm25_pack"
