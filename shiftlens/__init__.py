"""Structural-change analytics for warehouse metadata, as functions from DataFrames to DataFrames."""
