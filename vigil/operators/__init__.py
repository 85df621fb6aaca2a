"""Reusable operators: each takes and returns DataFrames."""
