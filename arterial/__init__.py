"""Network flow analytics on Spark: demand, paths, assignment, queues and reports as DataFrames."""
