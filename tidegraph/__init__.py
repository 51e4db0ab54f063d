"""A graph-cache retrieval engine over Spark DataFrames."""
