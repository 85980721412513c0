"""Code knowledge graph analytics on Spark DataFrames."""
