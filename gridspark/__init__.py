"""Gridded-data analytics as Spark DataFrames."""
