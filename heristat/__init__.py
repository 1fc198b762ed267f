"""heristat: moment-based variance-component analytics on Spark DataFrames."""
