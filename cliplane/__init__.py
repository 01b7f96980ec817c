"""Frame-sequence analytics on Spark."""
