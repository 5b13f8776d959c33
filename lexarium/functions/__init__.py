"""Scalar functions over DataFrames."""
