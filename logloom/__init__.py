"""logloom: log and corpus analytics on Spark DataFrames."""
