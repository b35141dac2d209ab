"""Health measures for labelled training datasets, as Spark DataFrames."""
