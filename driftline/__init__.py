"""Graph-weighted slow-feature analytics on Spark DataFrames."""
