"""Incremental code-graph analytics on Spark."""
