"""Registered queries (catalog) and their DuckDB twins (oracle)."""
