"""Change feeds to governed lake tables on Spark DataFrames."""
