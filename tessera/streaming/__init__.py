"""Streaming as functions over DataFrames."""
