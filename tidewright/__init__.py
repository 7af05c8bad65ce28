"""Entity-signal analytics on Spark DataFrames."""
