"""Nearest-facility analytics on road graphs, declared with Spark DataFrames."""
