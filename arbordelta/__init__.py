"""Tree comparison and record diffing on Spark DataFrames."""
