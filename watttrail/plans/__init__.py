"""Whole queries composed of operators, and the registry of those the driver runs."""

from watttrail.plans import ledger_queries, model_queries, source_queries, stream_queries

_MODULES = (ledger_queries, model_queries, source_queries, stream_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
