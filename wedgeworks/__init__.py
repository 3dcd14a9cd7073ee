"""Graph triangle analytics on Spark DataFrames."""
