"""Evidence and temporal analytics as plain functions from DataFrames to DataFrames."""
