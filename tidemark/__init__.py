"""Ordered, larger-than-memory analytics on Spark DataFrames."""
