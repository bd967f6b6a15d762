"""Plumbline: artifact-conformance analytics on Spark DataFrames."""
