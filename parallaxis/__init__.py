"""Multi-view 3-D point analytics on Spark DataFrames."""
