"""Access-log analytics and detection on Spark DataFrames."""
