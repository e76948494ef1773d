"""Queries: operators bound to the test tables, each with its SQL for DuckDB."""
