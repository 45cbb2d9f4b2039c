"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from strataweave.plans import eval_queries, io_queries, table_queries, text_queries
from strataweave.plans.registry import QUERIES, SQL

FLAGSHIP = "e1_flagship"
__all__ = ["FLAGSHIP", "QUERIES", "SQL", "eval_queries", "io_queries", "table_queries", "text_queries"]
