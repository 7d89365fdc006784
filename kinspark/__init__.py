"""Artifact-identity analytics on Spark DataFrames."""
