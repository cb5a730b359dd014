"""Orebody: resource-volume analytics as plain Spark DataFrames."""
