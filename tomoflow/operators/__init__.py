"""Operators over detector lines; each takes and returns DataFrames."""
