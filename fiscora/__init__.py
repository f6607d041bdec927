"""Document analytics on Spark DataFrames: fiscal extraction, supplier resolution, file plans and state."""
