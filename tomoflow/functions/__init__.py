"""Scalar functions: columns, and plain numbers for planning."""
