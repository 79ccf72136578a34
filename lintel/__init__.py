"""Code-review analytics and corpus preparation on Spark DataFrames."""
