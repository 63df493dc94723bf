"""Vehicle-bus log analytics on Spark DataFrames."""
