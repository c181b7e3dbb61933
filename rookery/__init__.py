"""Game-run analytics on Spark: DataFrames and column names in, DataFrames out."""
