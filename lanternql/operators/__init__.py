"""Relational operators: plans to DataFrames."""
