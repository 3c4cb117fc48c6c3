"""A memory-graph analytics engine on Spark DataFrames."""
