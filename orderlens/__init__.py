"""Order anomaly analytics built on Spark DataFrames and Structured Streaming."""
