"""Index builds over DataFrames."""
