"""Document-revision analytics expressed as Spark DataFrames."""
