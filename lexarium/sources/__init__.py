"""Sources over DataFrames."""
