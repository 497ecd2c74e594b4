"""Corpus annotation and authorship analytics on Spark DataFrames."""
