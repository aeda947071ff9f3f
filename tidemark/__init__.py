"""tidemark: numeric time series on Spark DataFrames."""
