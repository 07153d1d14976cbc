"""Document-set analytics on Spark DataFrames."""
