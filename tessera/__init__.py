"""Streaming and batch analytics as plain functions from DataFrames to DataFrames."""
