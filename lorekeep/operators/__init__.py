"""Relational operators: every one is a plain function from DataFrames to a DataFrame."""
