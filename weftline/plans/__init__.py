"""Registered queries: importing this package fills registry.QUERIES and registry.ORACLES."""

from weftline.plans import incremental_queries, registry, source_queries, summary_queries, table_queries  # noqa: F401
