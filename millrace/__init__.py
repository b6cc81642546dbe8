"""millrace: log and event analytics on Spark DataFrames."""
