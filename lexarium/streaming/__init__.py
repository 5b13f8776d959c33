"""Incremental ingest over DataFrames."""
