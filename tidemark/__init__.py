"""Evidence analytics on Spark: dated statements in, positions over time out."""
