"""Analytics for event-based, single-cell measurements on Spark DataFrames."""
