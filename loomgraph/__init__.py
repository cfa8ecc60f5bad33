"""Graph and deduplication analytics on Spark."""
