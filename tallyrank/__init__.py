"""Profile ranking and analytics on Spark DataFrames, Spark SQL and Structured Streaming."""
