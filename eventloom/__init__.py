"""Security-event correlation on Spark DataFrames."""
