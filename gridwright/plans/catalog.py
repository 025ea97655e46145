"""All registered queries of the operations analytics."""

from gridwright.plans import coverage_queries, network_queries, service_queries, signal_queries

_PARTS = (coverage_queries, network_queries, signal_queries, service_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
