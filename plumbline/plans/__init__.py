"""Data products and the semantic layer: functions from DataFrames to DataFrames."""
