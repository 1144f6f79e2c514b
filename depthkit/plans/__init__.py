"""Registered queries: each pairs a Spark job over the driver tables with a DuckDB oracle."""
