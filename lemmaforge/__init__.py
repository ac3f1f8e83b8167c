"""Headword-corpus analytics on Spark DataFrames."""
