"""Curation analytics as Spark DataFrames: operators, sources, functions, plans and streams."""
