"""Pipelines of named components, run as Spark DataFrames."""
