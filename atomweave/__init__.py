"""Sparse coding and dictionary learning on Spark DataFrames."""
