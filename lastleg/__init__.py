"""lastleg: urban last-mile analytics on Spark DataFrames."""
