"""Cube algebra, spatial tables, sampling, ledgers and learning on Spark DataFrames."""

__version__ = "0.1.0"
