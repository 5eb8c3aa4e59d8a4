"""Operators: each takes and returns DataFrames."""
