"""Log analytics on Spark: replicated append-only logs as DataFrames."""
