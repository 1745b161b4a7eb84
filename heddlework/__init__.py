"""Metadata, profiling and lineage analytics as functions from DataFrames to DataFrames."""
