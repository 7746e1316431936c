"""Tidemark: typed record collections and event streams on Spark DataFrames."""
