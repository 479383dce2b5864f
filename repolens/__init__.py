"""Temporal analytics over version-control history, on Spark DataFrames."""

__version__ = "0.1.0"
