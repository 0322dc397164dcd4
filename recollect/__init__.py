"""Recollect: graph-memory and hybrid-retrieval analytics on Spark DataFrames."""
