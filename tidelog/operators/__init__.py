"""Operators of the log model: each takes and returns DataFrames."""
