"""Station analytics on Spark DataFrames."""
