"""quarry: evidence analytics on Spark DataFrames."""
