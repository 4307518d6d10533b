"""Personal-knowledge-graph analytics on Spark DataFrames."""
