"""All queries of the core library and their SQL."""

from __future__ import annotations

from netsets.plans import domain_queries, domain_sql, edge_queries, model_queries, model_sql

QUERIES = {**edge_queries.QUERIES, **model_queries.QUERIES, **domain_queries.QUERIES}
SQL = {**edge_queries.SQL, **model_sql.SQL, **domain_sql.SQL}
FLAGSHIP = "closest_sets"
