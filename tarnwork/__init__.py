"""tarnwork: lakehouse pipeline operators as plain functions from DataFrames to a DataFrame."""

__version__ = "0.1.0"
