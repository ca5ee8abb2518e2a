"""Operators from DataFrames to DataFrames, partitioned by file."""
