"""Corpus search on Spark DataFrames: positional index, key evidence, ranking."""
