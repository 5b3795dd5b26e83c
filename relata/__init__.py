"""Relational context engine on Spark DataFrames."""
