"""Transcript and subtitle analytics on Spark DataFrames."""
