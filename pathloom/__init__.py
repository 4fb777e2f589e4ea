"""pathloom: routing-telemetry analytics on Spark DataFrames."""
