"""Aggregations, kernels and searches over DataFrames."""
