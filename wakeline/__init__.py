"""Dependency and blast-radius analytics on Spark DataFrames."""
