"""Operators on transport networks, demand and transit: DataFrames in, DataFrames out."""
