"""Retrieval-corpus construction and evaluation on PySpark DataFrames."""
