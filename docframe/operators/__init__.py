"""Operators on DataFrames; each returns lazy DataFrames."""
