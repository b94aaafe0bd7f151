"""Record verification and data-quality jobs on Spark DataFrames."""
