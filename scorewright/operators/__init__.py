"""Operators: each a function of DataFrames, with distributed aggregates and small results on the driver."""
