"""Folialis: document-library analytics on Spark DataFrames."""
