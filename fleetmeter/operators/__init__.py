"""The analytics: pure functions from DataFrames to a DataFrame."""
