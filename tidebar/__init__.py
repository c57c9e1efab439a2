"""Bar analytics and strategy replay on Spark DataFrames."""
