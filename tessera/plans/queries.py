"""All queries of the core, and the SQL they are compared with."""

from __future__ import annotations

from . import graph_queries, model_queries, text_queries

QUERIES = {**graph_queries.QUERIES, **text_queries.QUERIES, **model_queries.QUERIES}
ORACLE = {**graph_queries.ORACLE, **text_queries.ORACLE}
