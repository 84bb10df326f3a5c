"""Retrieval operators on DataFrames."""
