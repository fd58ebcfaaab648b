"""Operators: DataFrames and key columns in, DataFrames out."""
