"""Corpus-scale text analytics on Spark DataFrames."""
