"""Operators: each takes and returns DataFrames; key and order columns are always named by the caller."""
