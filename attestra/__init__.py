"""Provenance analytics and corpus preparation on Spark DataFrames."""
