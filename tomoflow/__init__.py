"""Declarative analytics over three-dimensional detector data, on Spark DataFrames."""
